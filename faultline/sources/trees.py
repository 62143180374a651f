"""Source files of a checked-out tree.

Spark's file readers skip names that start with ``_`` or ``.``, which would lose
every ``__init__.py``.  So tasks list and read the tree through pyarrow's file
systems, which also know shared stores.  The driver lists the top directory only.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories never entered, at any depth.
SKIPPED_DIRS = (
    ".git",
    "node_modules",
    "__pycache__",
    ".venv",
    "venv",
    ".tox",
    "site-packages",
    "dist",
    "build",
    ".next",
    ".cache",
)
DEFAULT_EXTENSIONS = (".py",)
# Paths in one batch of a listing.
LISTED = 1024


def extension(path: Column) -> Column:
    """From the last dot of the file name on; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def keeps_path(path: Column, extensions: Sequence[str] = ()) -> Column:
    """A wanted extension, and no skipped directory on the way to the file."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS)))
    return extension(path).isin(*(extensions or DEFAULT_EXTENSIONS)) & ~skipped


def _entered(store: fs.FileSystem, info: fs.FileInfo) -> bool:
    """Folders to walk: not the skipped ones, and no links, which lead elsewhere or back."""
    linked = isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path)
    return info.type == fs.FileType.Directory and info.base_name not in SKIPPED_DIRS and not linked


def _below(store: fs.FileSystem, base: str) -> Iterator[fs.FileInfo]:
    """Files under ``base``; folders that may not be read are passed over."""
    try:
        found = store.get_file_info(fs.FileSelector(base))
    except OSError:
        return
    for info in found:
        if info.type == fs.FileType.File:
            yield info
        elif _entered(store, info):
            yield from _below(store, info.path)


def tree_source(
    spark: SparkSession,
    root: str,
    repo: str,
    extensions: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """``repo, path, content`` of the wanted files, paths relative to ``root``."""
    uri = root if "://" in root else f"file://{root}"
    store, base = fs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    top = store.get_file_info(fs.FileSelector(base))
    names = [(i.path,) for i in top if i.is_file or _entered(store, i)]
    tasks = partitions or spark.sparkContext.defaultParallelism

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for entry in batch.column(0).to_pylist():
                info = place.get_file_info(entry)
                infos = [info] if info.is_file else _below(place, entry)
                for some in batched((found.path for found in infos), LISTED):
                    yield pa.RecordBatch.from_pydict({"full": list(some)})

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for full, path in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with place.open_input_stream(full) as stream:
                        body = stream.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "content": [body.decode("utf-8", "replace")]}
                )

    listed = (
        spark.createDataFrame(names, "entry string")
        .repartition(tasks)
        .mapInArrow(walk, "full string")
        .withColumn("path", F.substr("full", F.lit(len(base) + 2)))
        .where(keeps_path(F.col("path"), extensions))
    )
    return (
        listed.repartition(tasks, "full")
        .mapInArrow(load, "path string, content string")
        .select(F.lit(repo).alias("repo"), "path", "content")
    )
