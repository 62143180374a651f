"""Plain log files: one record per line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.schema import ORIGIN, RAW_LOG


def raw_log(df: DataFrame) -> DataFrame:
    """The RAW_LOG columns and the origin (NULL if ``df`` has none), in order and typed."""
    if "origin" not in df.columns:
        df = df.withColumn("origin", F.lit(None))
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in (*RAW_LOG.fields, ORIGIN)))


def _reader(spark: SparkSession, streaming: bool, options: dict[str, str]):
    reader = spark.readStream if streaming else spark.read
    # Only "\n" ends a line; a "\r" stays part of it.
    return reader.format("text").options(lineSep="\n", **options)


def _row_numberer(file: str):
    """Add to ``seq``, where a row's split starts, the row's place in the split.

    A row takes a byte at least, so the places of a split stay below the start of the next one.  A
    row that begins right at a border belongs to the split before it, hence the one added.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row = None, 0
        for batch in batches:
            if batch.num_rows:
                start = batch.column("seq").to_numpy()
                name = pc.fill_null(batch.column(file), "").dictionary_encode().indices.to_numpy()
                place = np.arange(len(start))
                fresh = np.ones(len(start), dtype=bool)
                fresh[1:] = (start[1:] != start[:-1]) | (name[1:] != name[:-1])
                fresh[0] = (batch.column(file)[0].as_py(), start[0]) != last
                begin = np.flatnonzero(fresh)
                part = np.cumsum(fresh)
                rows = place + row if not len(begin) else np.where(part == 0, place + row, place - begin[part - 1])
                last, row = (batch.column(file)[-1].as_py(), start[-1]), int(rows[-1]) + 1
                seq = pa.array(start + rows + (start > 0), pa.int64())
                batch = batch.set_column(batch.schema.get_field_index("seq"), "seq", seq)
            yield batch

    return run


def number_stream_rows(rows: DataFrame, file: str) -> DataFrame:
    """Streamed rows with ``seq`` counting on from the start of the split each row was read from."""
    return rows.mapInArrow(_row_numberer(file), rows.schema)


def read_text_files(
    spark: SparkSession,
    paths: str | list[str],
    streaming: bool = False,
    numbered: bool = True,
    **options: str,
) -> DataFrame:
    """Lines with their file, position and the file's modification time.

    ``seq`` rises along a file and is unique in it; files are the origins of lines.  In a
    batch it is a row id: the scan hands out the splits of a file to tasks by falling size and
    keeps equal ones in order, and only the last split of a file is shorter.  In a stream, where
    row ids are not to be had, it is counted from the start of the row's split; rows that
    are taken apart first come with that start alone (not ``numbered``).
    """
    if streaming and not isinstance(paths, str):
        # A file stream takes one path; several are several streams.
        streams = [read_text_files(spark, path, True, numbered, **options) for path in paths]
        return reduce(DataFrame.unionByName, streams)
    loaded = _reader(spark, streaming, options).load(paths)
    lines = loaded.select(
        F.col("value").alias("line"),
        F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("file_path"),
        (
            F.col("_metadata.file_block_start") if streaming else F.monotonically_increasing_id()
        ).alias("seq"),
        F.col("_metadata.file_modification_time").alias("ts"),
    )
    return number_stream_rows(lines, "file_path") if streaming and numbered else lines


def file_source(
    spark: SparkSession, paths: str | list[str], streaming: bool = False, **options: str
) -> DataFrame:
    """RAW_LOG of log files, tagged with ``file_path``.

    A stream reads whole new files; its checkpoint remembers the ones it has read.
    """
    lines = read_text_files(spark, paths, streaming, **options)
    return raw_log(
        lines.select(
            F.lit("file").alias("source"),
            F.col("file_path").alias("origin"),
            "seq",
            "ts",
            "line",
            F.create_map(F.lit("file_path"), F.col("file_path")).alias("tags"),
        )
    )
