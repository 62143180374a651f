"""Delivery of assembled events as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.schema import ENVELOPE_COLUMNS

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def envelope_json(*, without: tuple[str, ...] = ()) -> Column:
    """The event columns as one JSON object; absent optional parts are left out."""
    columns = [c for c in ENVELOPE_COLUMNS if c not in without]
    parts = {c: F.col(c) for c in columns}
    if "tags" in parts:
        parts["tags"] = F.when(F.size("tags") > 0, F.col("tags"))
    body = F.struct(*(parts[c].alias(c) for c in columns))
    return F.to_json(body, {"timestampFormat": TIME_FORMAT, "ignoreNullFields": "true"})


def queue_rows(events: DataFrame, queue: str) -> DataFrame:
    """Events as rows for the retry queue: body and size."""
    body = envelope_json()
    return events.select(
        F.lit(queue).alias("queue"),
        "event_id",
        body.alias("body"),
    ).withColumn("bytes", F.octet_length("body").cast("bigint"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events as JSON lines, one folder per project and day.

    Rows are brought together by folder before the write, so that a folder gets few
    files; a folder with many rows is split again by their size.
    """
    (
        events.select(
            "project_id",
            F.to_date("timestamp").alias("day"),
            envelope_json().alias("value"),
        )
        .hint("rebalance", "project_id", "day")
        .write.mode(mode)
        .partitionBy("project_id", "day")
        .text(path)
    )
