"""Token-bucket rate limiting of an unbounded stream.

``rate_limit_stream`` goes by a time that each event has.  ``BatchLimiter`` limits whole
micro-batches, whose events have no time but that of their batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from faultline.operators.ratelimit import DEFAULT_BURST, DEFAULT_RATE, decide, units
from faultline.operators.scan import with_totals_before
from faultline.streaming.order import by_seq
from faultline.streaming.records import JSON_OPTIONS


class KeyBucket(StatefulProcessor):
    """One token bucket per key; its state is three numbers."""

    def __init__(self, rate: int, burst: int):
        self.token, self.refill = units(rate)
        self.slack = self.token * (burst - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Numbers of any size, as text.
        schema = T.StructType(
            [
                T.StructField("level", T.StringType()),
                T.StructField("seen", T.LongType()),
                T.StructField("clock", T.LongType()),
            ]
        )
        self.bucket = handle.getValueState("bucket", schema)

    def handleInputRows(
        self, key: Any, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        level, seen, clock = self.bucket.get() if self.bucket.exists() else (None, 0, None)
        level = None if level is None else int(level)
        for row in by_seq(rows):
            clock = max(row.micros, clock) if clock is not None else row.micros
            seen += 1
            barrier = self.token * seen - self.refill * clock
            (allowed,), level = decide(level, (barrier,), self.slack, self.token)
            yield Row(limiter_key=key[0], event=row.event, allowed=allowed)
        self.bucket.update((str(level), seen, clock))

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame,
    key: Column | str = "source",
    rate: int = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
) -> DataFrame:
    """Streaming ``events`` with ``limiter_key`` and ``allowed``.

    Needs ``seq`` and ``ts``.  Batches follow each other; inside one, events are taken
    in ``seq`` order.
    """
    column = F.col(key) if isinstance(key, str) else key
    rows = events.select(
        F.coalesce(column.cast("string"), F.lit("")).alias("limiter_key"),
        F.col("seq").cast("bigint").alias("seq"),
        F.to_json(F.struct(*events.columns), JSON_OPTIONS).alias("event"),
        F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("micros"),
    )
    output = T.StructType(
        [
            T.StructField("limiter_key", T.StringType()),
            T.StructField("event", T.StringType()),
            T.StructField("allowed", T.BooleanType()),
        ]
    )
    limited = rows.groupBy("limiter_key").transformWithState(
        statefulProcessor=KeyBucket(rate, burst),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
    )
    decoded = limited.withColumn("event", F.from_json("event", events.schema, JSON_OPTIONS))
    return decoded.select("limiter_key", "event.*", "allowed")


class BatchLimiter:
    """Verdicts on micro-batches, one bucket per key, from counts per key alone.

    The events of a batch have come since the batch before.  So the bucket is capped at
    ``burst`` at that time, and all it refills from then to the batch's own time ``ts`` is
    theirs.  Of a key with more events than tokens the first ones by ``seq`` pass.

    After a pause in which no trigger found data, a batch's events have come within the
    last ``trigger_ms``.  The events of the first batch have come at once.

    Buckets that are not full are kept under ``path`` in two folders in turn: a batch reads
    the latest one before it and writes the other, so a batch that is run again finds what
    the first run found.  A full bucket is like one never used and is left out.
    """

    STATE = "batch long, limiter_key string, level decimal(38,0), clock long, ended long"

    def __init__(
        self,
        path: str,
        key: Column | str = "source",
        rate: int = DEFAULT_RATE,
        burst: int = DEFAULT_BURST,
        trigger_ms: int = 60_000,
        clock: Callable[[], int] = time.time_ns,
    ):
        self.path, self.key, self.trigger, self.clock = path, key, trigger_ms * 1000, clock
        self.token, self.refill = units(rate)
        self.full = self.token * burst
        self.held: DataFrame | None = None

    def _before(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, str, int | None, int | None]:
        """Buckets after the last batch, the folder free to be written, when that batch began and ended."""
        spark = batch.sparkSession
        found = []
        for slot in ("a", "b"):
            # Creates the folder of a stream that starts.
            spark.createDataFrame([], self.STATE).write.mode("append").parquet(f"{self.path}/{slot}")
            state = spark.read.schema(self.STATE).parquet(f"{self.path}/{slot}")
            clock = state.where(f"limiter_key is null and batch < {batch_id}").select("batch", "clock", "ended").first()
            if clock is not None:
                found.append((clock.batch, slot, clock.clock, clock.ended, state))
        if not found:
            return spark.createDataFrame([], self.STATE), "a", None, None
        _, slot, clock, ended, state = max(found, key=lambda f: f[0])
        return state.where("limiter_key is not null"), "b" if slot == "a" else "a", clock, ended

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``batch`` with ``limiter_key`` and ``allowed``; it should be persisted, as it is read more than once."""
        column = F.col(self.key) if isinstance(self.key, str) else self.key
        keyed = batch.withColumn("limiter_key", F.coalesce(column.cast("string"), F.lit("")))
        now = batch.agg(F.unix_micros(F.max("ts"))).first()[0]
        if now is None:
            return keyed.withColumn("allowed", F.lit(True))
        state, slot, clock, ended = self._before(batch, batch_id)
        if clock is None:
            clock = since = now
        else:
            now = max(now, clock)
            since = clock if ended + self.trigger >= now else max(clock, now - self.trigger)
        level = F.coalesce("level", F.lit(self.full)) + F.lit(self.refill * (since - clock))
        tokens = F.least(level, F.lit(self.full)) + F.lit(self.refill * (now - since))
        counts = keyed.groupBy("limiter_key").agg(F.count("*").alias("_n"))
        buckets = (
            state.select("limiter_key", "level")
            .join(counts, "limiter_key", "full")
            .select("limiter_key", F.coalesce("_n", F.lit(0)).alias("_n"), tokens.cast("decimal(38,0)").alias("_tokens"))
            .withColumn("_passed", F.least("_n", F.call_function("div", F.col("_tokens"), F.lit(self.token)).cast("long")))
        ).persist()
        if self.held is not None:  # those of the batch before
            self.held.unpersist()
        self.held = buckets
        left = F.least(F.col("_tokens") - F.col("_passed") * F.lit(self.token), F.lit(self.full))
        after = buckets.select("limiter_key", left.cast("decimal(38,0)").alias("level")).where(F.col("level") < self.full)
        mark = batch.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("limiter_key"), F.lit(None).cast("decimal(38,0)").alias("level")
        )
        stamps = {"batch": batch_id, "clock": now, "ended": max(now, self.clock() // 1000)}
        rows = after.union(mark).withColumns({name: F.lit(value).cast("long") for name, value in stamps.items()})
        names = [part.split()[0] for part in self.STATE.split(", ")]
        rows.select(names).write.mode("overwrite").parquet(f"{self.path}/{slot}")

        over = buckets.where("_passed < _n").select("limiter_key", "_passed")
        free = keyed.join(over, "limiter_key", "left_anti").withColumn("allowed", F.lit(True))
        ranked = with_totals_before(
            keyed.join(over, "limiter_key"), ["limiter_key"], "seq", sums={"_rank": F.lit(1)}
        )
        held = ranked.withColumn("allowed", F.col("_rank") < F.col("_passed")).select(free.columns)
        return free.union(held)
