"""Layered extraction and assembly of the delivered event."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.once import with_once
from faultline.functions.text import blank_to_null, let
from faultline.operators.fallback import KEYWORDS, fallback_event, has_keyword
from faultline.operators.json_events import json_event
from faultline.operators.redact import redact
from faultline.operators.scan import with_totals_before
from faultline.operators.traces import (
    go_event,
    java_event,
    node_event,
    python_event,
    ruby_event,
)
from faultline.schema import ENVELOPE_COLUMNS
from faultline.session import configure

# (name, extractor) or (name, extractor, gate): a gate is a cheap test that every text
# with an event of the layer passes.
Layer = tuple[str, Callable[[Column], Column]] | tuple[str, Callable[[Column], Column], Callable[[Column], Column]]
Fallback = Callable[[Column, Sequence[str]], Column]

# Highest confidence first; the first layer with an event wins.
LAYERS: tuple[Layer, ...] = (
    ("json", json_event),
    ("python", python_event),
    ("java", java_event),
    ("go", go_event),
    ("node", node_event),
    ("ruby", ruby_event),
)


def may_hold_event(text: Column, keywords: Sequence[str] = ()) -> Column:
    """Cheap test every record with an event passes.

    Each trace shape holds one of the default words, ``THROWABLE`` or ``:in ```.  JSON at
    error level spells a level out in letters, or in escapes, after a brace.
    """

    def holds(upper: Column) -> Column:
        json_words = [F.contains(upper, F.lit(word)) for word in ("ERR", "CRIT", "\\U")]
        json_like = F.contains(upper, F.lit("{")) & reduce(Column.__or__, json_words)
        tests = [F.contains(upper, F.lit(word)) for word in (*KEYWORDS, "THROWABLE", ":IN `")]
        return reduce(Column.__or__, [*tests, json_like])

    passed = let(F.upper(text), holds)
    return passed | has_keyword(text, keywords) if keywords else passed


def gate_of(layers: Sequence[Layer], keywords: Sequence[str] = ()) -> Callable[[Column], Column] | None:
    """A test that every text with an event passes, NULL where there is none.

    The built-in layers share one; a layer of one's own has to bring its gate, or all
    texts are tried.
    """
    own = [layer for layer in layers if layer not in LAYERS]
    if any(len(layer) < 3 for layer in own):
        return None

    def passes(text: Column) -> Column:
        return reduce(Column.__or__, [gate(text) for _, _, gate in own], may_hold_event(text, keywords))

    return passes


def extract_event(
    text: Column,
    layers: Sequence[Layer] = LAYERS,
    keywords: Sequence[str] = (),
    fallback: Fallback = fallback_event,
) -> Column:
    """EVENT of the first layer that recognises ``text``, NULL when none does."""
    tried = [layer[1](text) for layer in layers]
    return F.coalesce(*tried, fallback(text, keywords))


def merge_tags(own: Column, parser: Column, source_tags: Column, source: Column) -> Column:
    """Extractor tags and ``parser``, under source tags, under ``log_source``."""
    empty = F.create_map().cast("map<string,string>")
    given = F.coalesce(source_tags, empty)
    mine = F.map_concat(
        F.map_filter(F.coalesce(own, empty), lambda k, _: k != "parser"),
        F.create_map(F.lit("parser"), parser),
    )
    under = F.map_filter(mine, lambda k, _: ~F.map_contains_key(given, k) & (k != "log_source"))
    over = F.map_filter(given, lambda k, _: k != "log_source")
    return F.map_concat(
        under, over, F.create_map(F.lit("log_source"), F.coalesce(source, F.lit("")))
    )


def event_id(stream_key: Column, seq: Column, ts: Column, text: Column) -> Column:
    """Stable id in UUID shape: the same record always gets the same one."""
    micros = F.unix_micros(ts).cast("string")
    digest = F.sha2(F.concat_ws("\x1f", stream_key, seq.cast("string"), micros, text), 256)
    return F.regexp_replace(
        F.substring(digest, 1, 32),
        r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def event_ids(events: DataFrame) -> DataFrame:
    """Events with ``event_id``, which no other file and no cut of a file changes.

    Where ``seq`` counts inside an ``origin`` of a batch it is a row id, which depends on what else
    is read.  The id then is that of the stream, origin, time and text, and of how many
    like it came before.
    """
    if "origin" not in events.columns:
        return events.withColumn("event_id", event_id(F.col("stream_key"), F.col("seq"), F.col("ts"), F.col("line")))
    place = F.concat_ws("\x1f", "stream_key", F.coalesce("origin", F.lit("")))
    if events.isStreaming:
        return events.withColumn("event_id", event_id(place, F.col("seq"), F.col("ts"), F.col("line")))
    alike = F.sha2(F.concat_ws("\x1f", place, F.unix_micros("ts").cast("string"), "line"), 256)
    told = with_totals_before(events.withColumn("_alike", alike), ["_alike"], "seq", sums={"_nth": F.lit(1)})
    found = event_id(F.col("_alike"), F.col("_nth"), F.lit(None).cast("timestamp"), F.lit(""))
    return told.withColumn("event_id", found).drop("_alike", "_nth")


def extract(
    records: DataFrame,
    layers: Sequence[Layer] = LAYERS,
    keywords: Sequence[str] = (),
    prefilter: bool = True,
    fallback: Fallback = fallback_event,
) -> DataFrame:
    """Records with an ``event`` column; records without an event are dropped."""
    configure(records.sparkSession)
    gate = gate_of(layers, keywords) if prefilter else None
    if gate is not None:
        records = records.where(gate(F.col("line")))
    found = with_once(records, "event", extract_event(F.col("line"), layers, keywords, fallback))
    return found.where(F.col("event").isNotNull())


def scrub_and_extract(
    records: DataFrame,
    redactions: Sequence[str] = (),
    custom_redactions: Sequence[str] = (),
    layers: Sequence[Layer] = LAYERS,
    keywords: Sequence[str] = (),
    fallback: Fallback = fallback_event,
) -> DataFrame:
    """Records redacted, then extracted; records without an event are dropped.

    Redaction replaces text by bracketed markers, none of which holds, or can complete,
    a word the pre-filter looks for.  So the pre-filter may run first, and most records
    never meet the redaction patterns.  Own keywords and own layers could match a
    marker; with them it runs after.
    """
    configure(records.sparkSession)
    after = bool(keywords) or any(layer not in LAYERS for layer in layers)
    if not after:
        records = records.where(may_hold_event(F.col("line")))
    clean = with_once(records, "line", redact(F.col("line"), redactions, custom_redactions))
    return extract(clean, layers, keywords, prefilter=after, fallback=fallback)


def assemble(events: DataFrame, project_id: str, arrival: bool = False) -> DataFrame:
    """Full events: id, time, project and merged tags around the extraction.

    ``arrival`` adds ``arrived_at``, the time the source gave the record.  It is never a
    time that is written in the record.
    """
    e = F.col("event")
    columns = {
        "event_id": F.col("event_id"),
        "timestamp": F.coalesce(e["own_ts"], F.col("ts")),
        "project_id": F.lit(project_id),
        "platform": e["platform"],
        "level": e["level"],
        "environment": blank_to_null(e["environment"]),
        "release": blank_to_null(e["release"]),
        "server_name": blank_to_null(e["server_name"]),
        "message": blank_to_null(e["message"]),
        "exception": e["exception"],
        "tags": merge_tags(e["tags"], e["parser"], F.col("tags"), F.col("source")),
    }
    arrived = [F.col("ts").alias("arrived_at")] if arrival else []
    origin = ["origin"] if "origin" in events.columns else []
    return event_ids(events).select(
        "stream_key", *origin, "seq", *arrived, *(columns[name].alias(name) for name in ENVELOPE_COLUMNS)
    )
