"""Outcomes of delivery attempts, and the waits between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RETRIES = 5
DEFAULT_BASE_SECONDS = 1
DEFAULT_MAX_SECONDS = 60


def attempt_verdict(status: Column) -> Column:
    """``delivered`` for 2xx, ``permanent`` for 4xx, else ``retry``.

    A NULL status is a network error.
    """
    return (
        F.when(status.between(200, 299), "delivered")
        .when(status.between(400, 499), "permanent")
        .otherwise("retry")
    )


def outcomes(
    attempts: DataFrame,
    max_retries: int = DEFAULT_RETRIES,
    event: str = "event_id",
    attempt: str = "attempt",
    status: str = "status",
) -> DataFrame:
    """One row per event: how its delivery ended.

    Attempts count from 1 and the first terminal one decides; attempts after it,
    or after the last retry, never happened.  Without a terminal attempt the event
    is ``exhausted`` once all retries are used, else still ``pending``.
    """
    allowed = attempts.where(F.col(attempt) <= max_retries + 1)
    verdict = attempt_verdict(F.col(status))
    terminal = F.when(verdict != "retry", F.col(attempt))
    found = allowed.groupBy(event).agg(
        F.min(terminal).alias("_ended"),
        F.max(attempt).alias("_tried"),
        F.min_by(F.struct(verdict.alias("verdict"), F.col(status).alias("status")), terminal)
        .alias("_end"),
        F.max_by(F.struct(F.col(status).alias("status")), F.col(attempt)).alias("_last"),
    )
    outcome = F.when(F.col("_ended").isNotNull(), F.col("_end.verdict")).otherwise(
        F.when(F.col("_tried") > max_retries, "exhausted").otherwise("pending")
    )
    return found.select(
        event,
        outcome.alias("outcome"),
        F.coalesce("_ended", "_tried").cast("bigint").alias("attempts"),
        F.when(F.col("_ended").isNotNull(), F.col("_end.status"))
        .otherwise(F.col("_last.status"))
        .alias("last_status"),
    )


def backoff_before(
    attempt: Column,
    base_seconds: int = DEFAULT_BASE_SECONDS,
    max_seconds: int = DEFAULT_MAX_SECONDS,
) -> Column:
    """Seconds waited before an attempt: none before the first, then doubling."""
    # The shift is held below 2**40 so that a late attempt cannot overflow.
    doubled = F.lit(base_seconds).cast("bigint") * F.pow(
        F.lit(2), F.least(attempt - 2, F.lit(40))
    ).cast("bigint")
    # The first wait is the base even where that exceeds the maximum.
    return (
        F.when(attempt <= 1, F.lit(0).cast("bigint"))
        .when(attempt == 2, F.lit(base_seconds).cast("bigint"))
        .otherwise(F.least(doubled, F.lit(max_seconds).cast("bigint")))
    )


def total_backoff(
    attempts: Column,
    base_seconds: int = DEFAULT_BASE_SECONDS,
    max_seconds: int = DEFAULT_MAX_SECONDS,
) -> Column:
    """Seconds spent waiting by the time of the given attempt."""
    waits = F.transform(
        F.sequence(F.lit(1), F.greatest(attempts.cast("int"), F.lit(1))),
        lambda n: backoff_before(n, base_seconds, max_seconds),
    )
    return F.aggregate(waits, F.lit(0).cast("bigint"), lambda total, wait: total + wait)
