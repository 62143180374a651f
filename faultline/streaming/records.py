"""Multi-line recombination of an unbounded stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from faultline.operators.recombine import RULES, Rule
from faultline.session import checkpoint_root
from faultline.streaming.order import by_seq
from faultline.streaming.sink import run_available

DEFAULT_IDLE_MS = 500
#: Stream and time of the line that ends a stream; no stream key has a zero character.
END_KEY, END_TIME = "\0end", "9999-01-01 00:00:00"
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "ignoreNullFields": "false",
}


class OpenRecord(StatefulProcessor):
    """Holds the record each stream has open and emits it once it is complete.

    The continuation rule is worked out before, on the JVM, as three flags per line.
    """

    def __init__(self, keys: list[str], gap_ms: int | None, idle_ms: int | None, time_mode: str):
        self.keys = keys
        self.gap_ms = gap_ms
        self.idle_ms = idle_ms
        self.time_mode = time_mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        last = T.StructType(
            [
                T.StructField("opening", T.BooleanType()),
                T.StructField("micros", T.LongType()),
                T.StructField("first", T.StringType()),
            ]
        )
        line = T.StructType([T.StructField("line", T.StringType())])
        self.last = handle.getValueState("last", last)
        self.lines = handle.getListState("lines", line)

    def _emit(self, key: Any, first: str, lines: list[str]) -> Row:
        named = dict(zip(self.keys, key))
        return Row(**named, first=first, line="\n".join(lines), n_lines=len(lines))

    def handleInputRows(
        self, key: Any, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        opening, micros, first = self.last.get() if self.last.exists() else (None, None, None)
        # Lines before this batch stay in the state unless their record ends here.
        stored, added = first is not None, []
        for row in by_seq(rows):
            joined = first is not None and (row.alone or (row.closing and opening))
            if joined and self.gap_ms is not None and None not in (micros, row.micros):
                joined = row.micros - micros < self.gap_ms * 1000
            if not joined:
                if first is not None:
                    before = [line for (line,) in self.lines.get()] if stored else []
                    yield self._emit(key, first, before + added)
                if stored:
                    self.lines.clear()
                first, added, stored = row.first, [], False
            added.append(row.line)
            opening, micros = row.opening, row.micros
        if added:
            self.lines.appendList([(line,) for line in added])
        self.last.update((opening, micros, first))
        self._set_timer(timerValues, micros)

    def _set_timer(self, timerValues: TimerValues, micros: int | None) -> None:
        if self.time_mode == "None" or self.idle_ms is None:
            return
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if self.time_mode == "ProcessingTime":
            start = timerValues.getCurrentProcessingTimeInMs()
        else:
            start = max((micros or 0) // 1000, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(start + self.idle_ms)

    def handleExpiredTimer(
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        if self.last.exists():
            _, _, first = self.last.get()
            yield self._emit(key, first, [line for (line,) in self.lines.get()])
            self.last.clear()
            self.lines.clear()

    def close(self) -> None:
        pass


def recombine_stream(
    lines: DataFrame,
    rule: str | Rule = "universal",
    idle_ms: int | None = DEFAULT_IDLE_MS,
    time_mode: str = "ProcessingTime",
    event_gaps: bool | None = None,
) -> DataFrame:
    """Records of a streaming ``lines``, with the columns ``recombine`` gives.

    A record ends with the first line that does not continue it.  The last one of a
    quiet stream ends ``idle_ms`` later: by the clock, or with
    ``time_mode="EventTime"`` when the watermark on ``ts`` passes that; with
    ``time_mode="None"`` it stays open.  ``event_gaps`` also ends a record at a pause
    that long between the times of two lines, as the batch operator does; in event time
    that is the default.

    A batch of one stream is sorted in one task, in runs on its disk where it is large, so size
    the batches with ``maxFilesPerTrigger`` or its like.
    """
    flags = RULES[rule] if isinstance(rule, str) else rule
    keys = ["stream_key", *(["origin"] if "origin" in lines.columns else [])]
    carried = [c for c in lines.columns if c not in (*keys, "line")]
    line = F.rtrim(F.coalesce("line", F.lit("")), F.lit("\n"))
    # The first line's columns pass through the state as one text.
    carried_type = lines.select(*carried).schema
    first = F.to_json(F.struct(*carried), JSON_OPTIONS)
    rows = lines.select(
        *(F.coalesce(key, F.lit("")).alias(key) for key in keys),
        F.col("seq").alias("seq"),
        first.alias("first"),
        line.alias("line"),
        F.unix_micros("ts").alias("micros"),
        *(["ts"] if time_mode == "EventTime" else []),
    ).withColumns(
        {
            "alone": F.coalesce(flags.alone(F.col("line")), F.lit(False)),
            "closing": F.coalesce(flags.closing(F.col("line")), F.lit(False)),
            "opening": F.coalesce(flags.opening(F.col("line")), F.lit(False)),
        }
    )
    output = T.StructType(
        [
            *(T.StructField(key, T.StringType()) for key in keys),
            T.StructField("first", T.StringType()),
            T.StructField("line", T.StringType()),
            T.StructField("n_lines", T.LongType()),
        ]
    )
    gaps = time_mode == "EventTime" if event_gaps is None else event_gaps
    gap_ms = idle_ms if gaps else None
    processor = OpenRecord(keys, gap_ms, idle_ms, time_mode)
    records = rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor,
        outputStructType=output,
        outputMode="Append",
        timeMode=time_mode,
    )
    decoded = records.withColumn("first", F.from_json("first", carried_type, JSON_OPTIONS))
    return decoded.select(
        *keys, *(F.col(f"first.{c}").alias(c) for c in carried), "line", "n_lines"
    )


def recombine_to_the_end(
    lines: DataFrame,
    rule: str | Rule = "universal",
    idle_ms: int = DEFAULT_IDLE_MS,
    event_gaps: bool = False,
) -> DataFrame:
    """All records of a streaming ``lines`` that has come to its end, as a written table.

    The stream runs over all input there is, then once more over one line of the far future:
    the watermark passes every timer, and the records still open close.  ``lines`` has no
    watermark of its own.
    """
    spark = lines.sparkSession
    folder = f"{checkpoint_root(spark)}/ended-{uuid.uuid4()}"
    spark.createDataFrame([], lines.schema).write.parquet(f"{folder}/end")
    end = spark.readStream.schema(lines.schema).parquet(f"{folder}/end")
    timed = lines.unionByName(end).withWatermark("ts", "0 seconds")
    records = recombine_stream(timed, rule, idle_ms, "EventTime", event_gaps)
    run_available(records, f"{folder}/records", f"{folder}/checkpoint")
    given = {"stream_key": F.lit(END_KEY), "ts": F.lit(END_TIME).cast("timestamp")}
    last = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in lines.schema]
    spark.range(1).select(*last).write.mode("append").parquet(f"{folder}/end")
    run_available(records, f"{folder}/records", f"{folder}/checkpoint")
    spark.createDataFrame([], records.schema).write.parquet(f"{folder}/records/run=none/batch=0")
    found = spark.read.schema(records.schema).parquet(f"{folder}/records/*/*")
    return found.where(F.col("stream_key") != END_KEY)
