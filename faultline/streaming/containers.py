"""Lines of container chunks that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from faultline.sources.containers import container_name, keeps_container
from faultline.sources.text import raw_log

CHUNK_SCHEMA = (
    "container_id string, names array<string>, chunk_no bigint, ts timestamp, payload string"
)
LINE_SCHEMA = (
    "container_id string, container_name string, line_no bigint, micros bigint, line string"
)


class OpenLine(StatefulProcessor):
    """Keeps the unfinished line of each container."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType(
            [T.StructField("rest", T.StringType()), T.StructField("lines", T.LongType())]
        )
        self.open = handle.getValueState("open", schema)

    def handleInputRows(
        self, key: Any, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        rest, lines = self.open.get() if self.open.exists() else ("", 0)
        pieces = [rest]
        for row in sorted(rows, key=lambda r: r.chunk_no):
            *ended, last = (row.payload or "").split("\n")
            for piece in ended:
                line = "".join([*pieces, piece])
                pieces = []
                yield Row(
                    container_id=key[0],
                    container_name=key[1],
                    line_no=lines,
                    micros=row.micros,
                    line=line,
                )
                lines += 1
            pieces.append(last)
        self.open.update(("".join(pieces), lines))

    def close(self) -> None:
        pass


def container_stream(chunks: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Streaming RAW_LOG of chunks given as ``container_id, names, chunk_no, payload``.

    With the chunks' arrival ``ts``, a line has the time of the chunk that ends it.
    """
    arrival = F.unix_micros("ts") if "ts" in chunks.columns else F.lit(None).cast("bigint")
    named = chunks.withColumn("container_name", container_name(F.col("names"))).where(
        keeps_container(F.col("container_name"), excluded)
    )
    lines = (
        named.select(
            "container_id", "container_name", "chunk_no", arrival.alias("micros"), "payload"
        )
        .groupBy("container_id", "container_name")
        .transformWithState(
            statefulProcessor=OpenLine(),
            outputStructType=LINE_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )
    return raw_log(
        lines.select(
            F.lit("docker").alias("source"),
            F.col("container_id").alias("origin"),
            F.col("line_no").alias("seq"),
            F.timestamp_micros("micros").alias("ts"),
            "line",
            F.create_map(F.lit("container_name"), F.col("container_name")).alias("tags"),
        )
    )
