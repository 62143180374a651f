"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import checkpoint_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``[\x20\x09-\x0D]``, the white space between words; bytes.split() cuts at the same.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes and rows of an Arrow batch: a batch is held by the JVM and by Python, several times over.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed.

    lower() is the faster of the two and right where every character is one byte.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    root = checkpoint_root(spark)
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in small batches from here on, a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def hash_sample(hashed: Column, size: int, total: int) -> Column:
    """A condition that about ``size`` of ``total`` rows meet, by their 64-bit hash: no order, no state."""
    if total <= size:
        return F.lit(True)
    return F.shiftrightunsigned(hashed, 16) < F.lit(int((1 << 48) * size / total))


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows in runs of about ``size`` characters or bytes of their last column, a single text aside."""
    run, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in zip(*(column.to_pylist() for column in batch.slice(start, 256).columns)):
                run.append(row)
                held += len(row[-1] or "")
                if held >= size:
                    yield run
                    run, held = [], 0
    if run:
        yield run
