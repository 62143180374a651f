"""The bounded retry queue as tables of (queue, seq, body, bytes).

Every operator that depends on queue order uses running totals over buckets of
``seq``, so one long queue is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scan import BUCKET_ROWS, bucket_of, with_totals_before

DEFAULT_CAP_BYTES = 500 * 1024 * 1024


def retain_newest(
    entries: DataFrame,
    cap_bytes: int = DEFAULT_CAP_BYTES,
    queue: str = "queue",
    seq: str = "seq",
    size: str = "bytes",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Newest entries whose sizes add up to the cap; the newest always stays."""
    # Bucket totals show where the cap falls; entries of older buckets go before any shuffle.
    bucket = bucket_of(F.col(seq).cast("bigint"), bucket_rows)
    totals = entries.groupBy(F.col(queue).alias("_queue"), bucket.alias("_b")).agg(F.sum(size).alias("_sum"))
    newer = Window.partitionBy("_queue").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        totals.withColumn("_above", F.coalesce(F.sum("_sum").over(newer), F.lit(0)))
        .where(F.col("_above") <= cap_bytes)
        .groupBy("_queue")
        .agg(F.min("_b").alias("_oldest"))
    )
    recent = entries.join(reached, F.col(queue).eqNullSafe(F.col("_queue"))).where(bucket >= F.col("_oldest"))
    counted = with_totals_before(
        recent.drop("_queue", "_oldest"),
        [queue],
        seq,
        sums={"_newer": F.lit(1), "_newer_bytes": F.col(size)},
        bucket_rows=bucket_rows,
        descending=True,
    )
    fits = F.col("_newer_bytes") + F.col(size) <= cap_bytes
    return counted.where(fits | (F.col("_newer") == 0)).drop("_newer", "_newer_bytes")


def replay(
    entries: DataFrame,
    failed: Column,
    corrupt: Column,
    queue: str = "queue",
    seq: str = "seq",
) -> DataFrame:
    """Entries with the ``action`` one ordered replay takes on them.

    ``delivered`` and ``discarded`` (unreadable) up to the first failed delivery;
    that entry and all later ones are ``remaining``.
    """
    stops = F.coalesce(failed, F.lit(False)) & ~F.coalesce(corrupt, F.lit(False))
    # The first failure of a queue decides about all its entries: one small row per queue.
    first = entries.where(stops).groupBy(F.col(queue).alias("_queue")).agg(F.min(seq).alias("_first"))
    action = (
        F.when(F.col(seq) >= F.col("_first"), "remaining")
        .when(F.coalesce(corrupt, F.lit(False)), "discarded")
        .otherwise("delivered")
    )
    met = entries.join(first, F.col(queue).eqNullSafe(F.col("_queue")), "left")
    return met.withColumn("action", action).drop("_queue", "_first")


def replay_counts(replayed: DataFrame, queue: str = "queue") -> DataFrame:
    """Delivered, discarded and remaining entries per queue."""
    return replayed.groupBy(queue).agg(
        *(
            F.count_if(F.col("action") == action).alias(action)
            for action in ("delivered", "discarded", "remaining")
        )
    )


def entry_seq(name: Column) -> Column:
    """Sequence number in an entry name of 20 digits and ``.json``, else NULL.

    Text after ``.json`` makes it another file.
    """
    digits = F.regexp_extract(name, r"\A(\d{20})\.json\z", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def entry_name(seq: Column) -> Column:
    return F.concat(F.lpad(seq.cast("string"), 20, "0"), F.lit(".json"))


def enqueue(
    names: DataFrame,
    arrivals: DataFrame,
    queue: str = "queue",
    order: str = "seq",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Arrivals with the ``entry_seq`` they get behind the entries in ``names``.

    ``names`` has ``queue, name``; numbering goes on from the highest number in a
    queue.  ``order`` is a unique non-negative integer per queue.
    """
    seed = (
        names.withColumn("_seq", entry_seq(F.col("name")))
        .groupBy(queue)
        .agg(F.max("_seq").alias("_step"))
        .select(
            queue,
            F.lit(-1).cast("bigint").alias(order),
            F.coalesce("_step", F.lit(0)).cast("bigint").alias("_step"),
        )
    )
    steps = arrivals.withColumns(
        {order: F.col(order).cast("bigint"), "_step": F.lit(1).cast("bigint")}
    )
    numbered = with_totals_before(
        steps.unionByName(seed, allowMissingColumns=True),
        [queue],
        order,
        sums={"_before": F.col("_step")},
        bucket_rows=bucket_rows,
    )
    return (
        numbered.where(F.col(order) >= 0)
        .withColumn("entry_seq", F.col("_before") + 1)
        .drop("_before", "_step")
    )


def occupancy(
    entries: DataFrame,
    cap_bytes: int = DEFAULT_CAP_BYTES,
    queue: str = "queue",
    size: str = "bytes",
) -> DataFrame:
    """Entries, bytes and cap per queue."""
    return entries.groupBy(queue).agg(
        F.count("*").alias("entries"),
        F.sum(size).alias("bytes"),
        F.lit(cap_bytes).cast("bigint").alias("cap"),
    )
