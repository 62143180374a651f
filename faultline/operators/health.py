"""Roll-up of source health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_health(reports: DataFrame) -> DataFrame:
    """One row per source from reports of lines and errors.

    ``reports`` has ``source, emitted, dropped, last_error, last_error_at``; counts
    add up and the latest report that has an error time tells the error.  An empty
    error text means the source has recovered.
    """
    rolled = reports.groupBy("source").agg(
        F.sum("emitted").alias("emitted"),
        F.sum("dropped").alias("dropped"),
        F.max_by("last_error", "last_error_at").alias("_error"),
    )
    error = F.nullif(F.col("_error"), F.lit(""))
    return rolled.select(
        "source",
        error.isNull().alias("healthy"),
        "emitted",
        "dropped",
        error.alias("last_error"),
    )


def overall_health(health: DataFrame) -> DataFrame:
    """``ok``, or ``degraded`` when any source is unhealthy."""
    return health.agg(
        F.when(F.bool_and("healthy"), "ok").when(F.count("*") == 0, "ok").otherwise("degraded")
        .alias("status"),
        F.count("*").alias("sources"),
        F.count_if(~F.col("healthy")).alias("unhealthy"),
    )
