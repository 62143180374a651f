"""Idempotent delivery of streaming results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.session import checkpoint_root


def batch_writer(
    path: str,
    file_format: str = "parquet",
    through: Callable[[DataFrame, int], DataFrame] = lambda batch, _: batch,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each batch, taken ``through`` a function, its own folder.

    A batch that is run again after a failure replaces its folder, so nothing is
    delivered twice.  The folder also carries the query's id, which lives in the
    checkpoint: a job that starts over with a new checkpoint counts its batches from 0 again
    and must not replace what an earlier one delivered.  Empty batches write nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()
        try:
            if batch.take(1):
                through(batch, batch_id).write.mode("overwrite").format(file_format).save(f"{path}/run={run}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all input there is now, then stop."""
    query = (
        stream.writeStream.foreachBatch(batch_writer(path))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def collect_available(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The rows a stream gives for all input there is now, as a written table."""
    folder = f"{checkpoint_root(spark)}/stream-{uuid.uuid4()}"
    run_available(stream, f"{folder}/rows", f"{folder}/checkpoint")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/run=none/batch=0")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*/*")
