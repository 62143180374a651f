"""From raw logs to delivered events, as a batch job and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.layered import LAYERS, Layer, assemble, scrub_and_extract
from faultline.operators.ratelimit import (
    DEFAULT_BURST,
    DEFAULT_RATE,
    limiter_stats,
    mark_sampled,
    rate_limit,
)
from faultline.operators.recombine import recombine, with_stream_key
from faultline.session import configure, materialise
from faultline.sources.sinks import write_events
from faultline.streaming.limiter import BatchLimiter
from faultline.streaming.records import DEFAULT_IDLE_MS, recombine_stream
from faultline.streaming.sink import batch_writer


def find_events(
    raw: DataFrame,
    project_id: str,
    rule: str = "universal",
    idle_ms: int | None = DEFAULT_IDLE_MS,
    redactions: Sequence[str] = (),
    custom_redactions: Sequence[str] = (),
    keywords: Sequence[str] = (),
    layers: Sequence[Layer] = LAYERS,
    arrival: bool = False,
) -> DataFrame:
    """Assembled error events of a RAW_LOG table; ``arrival`` keeps when they arrived."""
    records = recombine(with_stream_key(raw), rule, idle_ms)
    found = scrub_and_extract(records, redactions, custom_redactions, layers, keywords)
    return assemble(found, project_id, arrival)


def limit_events(
    events: DataFrame,
    key: Column | str = "stream_key",
    rate: int = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    mark: bool = False,
) -> DataFrame:
    """Events that pass the limiter, each stream having its own bucket by default.

    Needs ``arrived_at``, as ``find_events(arrival=True)`` gives it: a limiter runs on the
    time at which it meets an event, never on a time inside the record.  In an archive the
    lines of a file arrive together, so most of them would be dropped.

    The limiter reads its input several times, so the events are written down first.
    ``mark`` tags the events of streams that lost some with the 1-in-N rate.
    """
    limited = rate_limit(
        materialise(events.withColumn("ts", F.col("arrived_at"))), key, rate, burst
    )
    out = [c for c in events.columns if c != "arrived_at"]
    if not mark:
        return limited.where("allowed").select(*out)
    kept = mark_sampled(limited, limiter_stats(limited))
    tags = F.when(F.col("sampled").isNull(), F.col("tags")).otherwise(
        F.map_concat(
            F.map_filter("tags", lambda k, _: k != "sampled"),
            F.create_map(F.lit("sampled"), F.col("sampled")),
        )
    )
    return kept.withColumn("tags", tags).select(*out)


def run_batch(
    raw: DataFrame,
    project_id: str,
    path: str,
    rate: int | None = None,
    burst: int = DEFAULT_BURST,
    **options,
) -> None:
    """Find and write the events of a RAW_LOG table.

    A batch has no arrivals to speak of, so it delivers every event unless a ``rate`` is
    given; then the source's times are the arrivals.
    """
    configure(raw.sparkSession)
    events = find_events(raw, project_id, arrival=rate is not None, **options)
    write_events(events if rate is None else limit_events(events, rate=rate, burst=burst), path)


def start_stream(
    raw: DataFrame,
    project_id: str,
    path: str,
    checkpoint: str,
    rule: str = "universal",
    idle_ms: int = DEFAULT_IDLE_MS,
    redactions: Sequence[str] = (),
    custom_redactions: Sequence[str] = (),
    keywords: Sequence[str] = (),
    rate: int = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    trigger_ms: int = 60_000,
    layers: Sequence[Layer] = LAYERS,
) -> StreamingQuery:
    """Start the same work on a streaming RAW_LOG.

    The limiter takes the events of a batch as arrived since the batch before, whatever times
    their records claim, so a stream under its ``rate`` loses none however long the batches are.
    Open records live in the state store, buckets beside it under ``checkpoint``; each batch
    of events has its own folder under ``path``, so a batch that is run again is not
    delivered twice.
    """
    configure(raw.sparkSession)
    records = recombine_stream(with_stream_key(raw), rule, idle_ms)
    found = scrub_and_extract(records, redactions, custom_redactions, layers, keywords)
    events = assemble(found, project_id).withColumn("ts", F.current_timestamp())
    limiter = BatchLimiter(f"{checkpoint.rstrip('/')}-limiter", "stream_key", rate, burst, trigger_ms)

    def limit(batch: DataFrame, batch_id: int) -> DataFrame:
        return limiter(batch, batch_id).where("allowed").drop("allowed", "limiter_key", "ts")

    return (
        events.writeStream.foreachBatch(batch_writer(path, through=limit))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(processingTime=f"{trigger_ms} milliseconds")
        .start()
    )
