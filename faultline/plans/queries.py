"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.once import with_once
from faultline.functions.text import trim_space
from faultline.functions.variants import first_string, object_field, parse_object
from faultline.operators import codechunks, delivery, health, queue, ratelimit
from faultline.operators.fallback import fallback_event
from faultline.operators.json_events import (
    LEVEL_KEYS,
    MESSAGE_KEYS,
    TIME_KEYS,
    infer_platform,
    is_error_level,
    json_event,
    json_frames,
    json_level,
    normalise_level,
    parse_rfc3339,
    record_texts,
)
from faultline.operators.layered import LAYERS, assemble, extract_event, may_hold_event, scrub_and_extract
from faultline.operators.recombine import RULES, recombine, stream_key, with_stream_key
from faultline.operators.redact import redact, usable_patterns
from faultline.operators.traces import (
    go_event,
    java_event,
    node_event,
    python_event,
    ruby_event,
)
from faultline.plans import derived as D
from faultline.plans.derived import derive, spread, table
from faultline.schema import EVENT
from faultline.session import checkpoint_root, stored
from faultline.sources import containers, journal, otlp, pods, trees
from faultline.sources.sinks import envelope_json
from faultline.sources.text import file_source
from faultline.sources.union import union_sources
from faultline.streaming.limiter import rate_limit_stream
from faultline.streaming.records import recombine_to_the_end
from faultline.streaming.sink import collect_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROJECT = "demo"
IDLE_MS = 500
# Log times pressed together by this factor, so that idle gaps are common.
TIME_PRESS = 4000
LIMIT = {"rate": 1, "burst": 5}
RETAIN_BYTES = 30_000
CUSTOM_REDACTIONS = (r"[A-Z][a-z]+ [A-Z][a-z]+", "(", r"\d{4,}")
CUSTOM_KEYWORDS = ("REQUEST 1", "boom")
# These queries show the short form of a fallback event; the jobs keep whole texts.
short_fallback = partial(fallback_event, message_bytes=8000, raw_line_bytes=200)
FILE_SUBSET = ("email", "ipv6", "nosuch")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def frames_text(exception: Column) -> Column:
    """Frames as ``file|function|line|context`` joined by ``;``."""
    return F.array_join(
        F.transform(
            exception["stacktrace"]["frames"],
            lambda f: F.concat_ws(
                "|",
                f["filename"],
                f["function"],
                F.coalesce(f["lineno"].cast("string"), F.lit("")),
                F.coalesce(f["context_line"], F.lit("")),
            ),
        ),
        ";",
    )


def event_columns(event: Column) -> list[Column]:
    exc = event["exception"]
    return [
        exc["type"].alias("exc_type"),
        exc["value"].alias("exc_value"),
        event["message"].alias("message"),
        long(F.size(exc["stacktrace"]["frames"])).alias("n_frames"),
        frames_text(exc).alias("frames"),
    ]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived log lines with stream key and tags."""
    lines = derive(spark, sf_dir, D.LOG_LINES)
    tags = F.create_map(F.lit("file_path"), F.col("file_path"))
    return lines.select("stream_key", "source", "seq", "ts", "line", tags.alias("tags"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recombine(log_lines(spark, sf_dir))


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_once(log_records(spark, sf_dir), "line", redact(F.col("line")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(scrub_and_extract(log_records(spark, sf_dir), fallback=short_fallback), PROJECT)


# --- sources -------------------------------------------------------------------


@query
def text_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts written as log files, one folder per source, and read back."""
    folder = f"{checkpoint_root(spark)}/logs-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents").select("source", "text")
    docs.write.partitionBy("source").text(folder)
    read = file_source(spark, folder, recursiveFileLookup="true")
    path = F.element_at("tags", "file_path")
    return read.select(F.regexp_extract(path, "source=([^/]+)", 1).alias("folder"), "source", "line")


@query
def pod_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pods.decode_pod_lines(derive(spark, sf_dir, D.POD_LINES), ["staging"])
    tag = {t: F.element_at("tags", t) for t in
           ("k8s_namespace", "k8s_pod", "k8s_pod_uid", "k8s_deployment", "container_name")}
    return with_stream_key(raw).select(
        "stream_key", "source", "seq", "line", *(c.alias(t) for t, c in tag.items())
    )


@query
def pod_dir_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = derive(spark, sf_dir, D.POD_LINES).select("seq", "dirname")
    meta = dirs.select("seq", pods.pod_meta(F.col("dirname")).alias("m"))
    return meta.where(F.col("m").isNotNull()).select("seq", "m.namespace", "m.pod", "m.uid")


@query
def deployment_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = derive(spark, sf_dir, D.POD_LINES).select("seq", "dirname")
    pod = F.split("dirname", "_")[1]
    return dirs.select("seq", pod.alias("pod"), pods.deployment_name(pod).alias("deployment"))


@query
def namespace_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = derive(spark, sf_dir, D.POD_LINES).select("seq", "dirname")
    kept = dirs.withColumn("namespace", F.split("dirname", "_")[0])
    return kept.where(pods.keeps_namespace(F.col("namespace"), ["staging"])).groupBy(
        "namespace"
    ).agg(F.count("*").alias("n"))


def _journal(spark: SparkSession, sf_dir: str, units: tuple[str, ...] = ()) -> DataFrame:
    return journal.decode_journal(derive(spark, sf_dir, D.JOURNAL_LINES, heavy=True), units)


@query
def journal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = ("systemd_unit", "hostname", "priority")
    return _journal(spark, sf_dir).select(
        "source", "seq", "line", *(F.element_at("tags", t).alias(t) for t in tags)
    )


@query
def journal_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.rejected_entries(derive(spark, sf_dir, D.JOURNAL_LINES)).select("seq", "line")


@query
def journal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _journal(spark, sf_dir, ("nginx.service", "dbus.service"))
    return rows.select("seq", F.element_at("tags", "systemd_unit").alias("unit"))


@query
def journal_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).select("seq", F.unix_micros("ts").alias("micros"))


def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.flatten_requests(derive(spark, sf_dir, D.OTLP_REQUESTS, heavy=True))


@query
def otlp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otlp(spark, sf_dir).select("source", "seq", long("place").alias("place"), "line")


@query
def otlp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.rejected_requests(derive(spark, sf_dir, D.OTLP_REQUESTS, heavy=True)).select("seq", "payload")


@query
def otlp_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otlp(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"))


@query
def otlp_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otlp(spark, sf_dir).select(
        "seq", long("place").alias("place"), F.unix_micros("ts").alias("micros")
    )


@query
def otlp_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at("tags", "otel_severity")
    return _otlp(spark, sf_dir).groupBy(level.alias("severity")).agg(F.count("*").alias("n"))


@query
def otlp_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("otel_severity", "otel_scope", "trace_id", "span_id", "service_name", "hostname")
    return _otlp(spark, sf_dir).select(
        "seq",
        long("place").alias("place"),
        long(F.size("tags")).alias("n_tags"),
        *(F.try_element_at("tags", F.lit(t)).alias(t) for t in names),
    )


def _container_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container chunks, made once: lines are assembled from several reads of them."""
    return stored(derive(spark, sf_dir, D.CONTAINER_CHUNKS_SPARK, heavy=True), "chunks")


@query
def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.assemble_lines(_container_chunks(spark, sf_dir))


@query
def container_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = derive(spark, sf_dir, D.CONTAINER_CHUNKS_SPARK, heavy=True)
    names = F.when(F.col("source") == "src3", F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("/"), "source"), F.lit("/other"))
    )
    named = chunks.withColumn("name", containers.container_name(names))
    kept = named.where(containers.keeps_container(F.col("name"), ["src5", "src7"]))
    return kept.groupBy("container_id", "name").agg(F.count("*").alias("chunks"))


@query
def container_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.started_containers(derive(spark, sf_dir, D.CONTAINER_EVENTS))


@query
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, journal, pods, requests and containers in one raw log."""
    raw = ("source", "seq", "ts", "line", "tags")
    named = F.array(F.concat(F.lit("/"), "source"))
    readers = {
        "file": lambda s, c: log_lines(s, sf_dir).select(*raw),
        "journald": lambda s, c: _journal(s, sf_dir),
        "kubernetes": lambda s, c: pods.decode_pod_lines(derive(s, sf_dir, D.POD_LINES)),
        "otel": lambda s, c: _otlp(s, sf_dir).select(*raw),
        "docker": lambda s, c: containers.container_source(_container_chunks(s, sf_dir).withColumn("names", named)),
    }
    configs = [{"type": t} for t in readers] + [
        {"type": "pigeon"},
        {"type": "file", "enabled": False},
    ]
    logs = with_stream_key(union_sources(spark, configs, readers))
    return logs.groupBy("source", "stream_key").agg(
        F.count("*").alias("lines"), long(F.sum(F.length("line"))).alias("chars")
    )


@query
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that several origins share: containers of one name, two journals, the same files twice."""
    readers = {
        "file": lambda s, c: log_lines(s, sf_dir),
        "journald": lambda s, c: _journal(s, sf_dir),
        "docker": lambda s, c: containers.container_source(
            _container_chunks(s, sf_dir).withColumn("names", F.array(F.lit("/app")))
        ),
    }
    raw = union_sources(spark, [{"type": t} for t in ("file", "journald", "docker", "journald", "file")], readers)
    # Both operators read their rows several times; of a record's text only the length goes on.
    lines = stored(with_stream_key(raw).select("stream_key", "origin", "seq", "ts", "line"), "raw-log")
    sized = recombine(lines, bucket_rows=1000).withColumn("line", F.length("line"))
    records = stored(sized.withColumnRenamed("line", "chars"), "records")
    limited = ratelimit.rate_limit(records, "stream_key", rate=100, burst=50, block_rows=1000)
    return limited.groupBy("stream_key").agg(
        F.count("*").alias("records"),
        F.count_distinct("origin").alias("origins"),
        F.sum("n_lines").alias("lines"),
        long(F.sum("chars")).alias("chars"),
    )


@query
def source_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = derive(spark, sf_dir, D.TREE_PATHS)
    return paths.where(trees.keeps_path(F.col("path")))


@query
def envelope_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered JSON, read back field by field."""
    body = events(spark, sf_dir).select("stream_key", "seq", envelope_json().alias("body"))

    def part(path: str) -> Column:
        return F.get_json_object("body", f"$.{path}")

    return body.select(
        "stream_key",
        "seq",
        F.array_join(F.json_object_keys("body"), ",").alias("keys"),
        part("timestamp").alias("timestamp"),
        part("level").alias("level"),
        part("message").alias("message"),
        part("exception.type").alias("exc_type"),
        part("exception.stacktrace.frames[0].lineno").alias("line0"),
        part("tags.parser").alias("parser"),
        part("tags.file_path").alias("file_path"),
    )


@query
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derive(spark, sf_dir, D.SOURCE_FILES, heavy=True)
    repos = files.select("repo").distinct().select(
        "repo",
        F.concat(F.lit("https://git/"), "repo").alias("repo_url"),
        F.lit("main").alias("branch"),
        F.sha2(F.col("repo"), 256).alias("source_sha"),
    )
    batches = codechunks.chunk_batches(files, repos)
    names = F.transform(
        "chunks", lambda c: F.concat_ws(":", c["file_path"], c["start_line"], c["name"])
    )
    return batches.select(
        "repo_name",
        "repo_url",
        "branch",
        "source_sha",
        "batch_no",
        "done",
        long(F.size("chunks")).alias("n_chunks"),
        F.array_join(names, ",").alias("chunks"),
    )


# --- row transforms ------------------------------------------------------------


@query
def stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, D.TAGGED)
    named = F.map_from_arrays(
        F.array(*map(F.lit, ("k8s_pod", "container_name", "systemd_unit", "file_path"))),
        F.array("pod", "box", "unit", "file_path"),
    )
    tags = F.map_filter(named, lambda _, v: v.isNotNull())
    return rows.select("event_id", stream_key(F.col("source"), tags).alias("stream_key"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "documents")


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", redact(F.col("text")).alias("text"))


@query
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive(spark, sf_dir, D.SECRETS, heavy=True)
    return lines.select("event_id", redact(F.col("line")).alias("line"))


@query
def redact_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redact(F.col("text"), FILE_SUBSET)
    return _documents(spark, sf_dir).select("doc_id", clean.alias("text"))


@query
def redact_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = usable_patterns(spark, CUSTOM_REDACTIONS)
    clean = redact(F.col("text"), custom=patterns)
    return _documents(spark, sf_dir).select("doc_id", clean.alias("text"))


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines that are one object, parsed."""
    lines = derive(spark, sf_dir, D.JSON_LINES, heavy=True)
    text = trim_space(F.col("line"))
    parsed = with_once(lines, "record", F.when(text.startswith("{"), parse_object(text)))
    return parsed.select("event_id", "record").where(F.col("record").isNotNull())


def _json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive(spark, sf_dir, D.JSON_LINES, heavy=True)
    found = with_once(lines, "e", json_event(F.col("line")))
    return found.where(F.col("e").isNotNull())


@query
def normalise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json_records(spark, sf_dir)
    level = first_string(F.col("record"), *LEVEL_KEYS)
    return rows.select("event_id", level.alias("given"), normalise_level(level).alias("level"))


@query
def error_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = json_level(record_texts(F.col("record")))
    rows = with_once(_json_records(spark, sf_dir), "level", level)
    return rows.where(is_error_level(F.col("level"))).select("event_id", "level")


@query
def first_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json_records(spark, sf_dir)
    return rows.select("event_id", first_string(F.col("record"), *MESSAGE_KEYS).alias("message"))


@query
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_events(spark, sf_dir).select(
        "event_id", "e.level", "e.message", "e.environment", "e.release", "e.server_name"
    )


@query
def json_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = first_string(F.col("record"), *TIME_KEYS)
    rows = _json_records(spark, sf_dir).select("event_id", given.alias("given"))
    return rows.select("event_id", "given", F.unix_micros(parse_rfc3339(F.col("given"))).alias("micros"))


@query
def json_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    exc = F.col("e.exception")
    return _json_events(spark, sf_dir).where(exc.isNotNull()).select(
        "event_id",
        exc["type"].alias("exc_type"),
        exc["value"].alias("exc_value"),
        exc["stacktrace"].isNotNull().alias("has_trace"),
    )


@query
def json_frame_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = object_field(F.col("record"), "exception.stacktrace")
    rows = _json_records(spark, sf_dir).select(
        "event_id", F.posexplode(json_frames(trace)).alias("place", "f")
    )
    return rows.select(
        "event_id",
        long("place").alias("place"),
        "f.filename",
        "f.function",
        "f.lineno",
        "f.context_line",
    )


@query
def json_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json_records(spark, sf_dir)
    return rows.select("event_id", infer_platform(record_texts(F.col("record"))).alias("platform"))


def _trace_query(name: str, extractor: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_once(log_records(spark, sf_dir), "e", extractor(F.col("line")))
        kept = found.where(F.col("e").isNotNull())
        return kept.select("stream_key", "seq", *event_columns(F.col("e")))

    run.__name__ = name
    query(run)


_trace_query("python_tracebacks", python_event)
_trace_query("java_throwables", java_event)
_trace_query("go_panics", go_event)
_trace_query("node_stacks", node_event)
_trace_query("ruby_traces", ruby_event)


@query
def trace_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each through all layers."""
    found = scrub_and_extract(derive(spark, sf_dir, D.TRACES, heavy=True), fallback=short_fallback)
    return found.select("seq", F.col("event.parser").alias("parser"), *event_columns(F.col("event")))


@query
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_once(derive(spark, sf_dir, D.NOTES, heavy=True), "e", short_fallback(F.col("text")))
    return rows.where(F.col("e").isNotNull()).select(
        "doc_id", "e.message", F.element_at("e.tags", "raw_line").alias("raw_line")
    )


@query
def custom_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = short_fallback(F.col("line"), CUSTOM_KEYWORDS)
    rows = with_once(log_records(spark, sf_dir), "e", event)
    return rows.where(F.col("e").isNotNull()).select("stream_key", "seq", "e.message")


@query
def layered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scrub_and_extract(log_records(spark, sf_dir), fallback=short_fallback)
    return found.select(
        "stream_key", "seq", F.col("event.parser").alias("parser"), *event_columns(F.col("event"))
    )


def _oops_event(text: Column) -> Column:
    """A layer of one's own: ``OOPS`` and what broke, none of the words the built-in ones know."""
    what = F.regexp_extract(text, r"\AOOPS (.+)", 1)
    rest = [F.lit(None)] * 5
    event = F.struct(F.lit("oops"), F.lit("other"), F.lit("warning"), what, *rest, F.create_map(F.lit("k"), F.lit("v")))
    return F.when(what != "", event.cast(EVENT))


@query
def custom_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scrub_and_extract(derive(spark, sf_dir, D.OOPS), layers=(*LAYERS, ("oops", _oops_event)))
    return found.select("seq", F.col("event.parser").alias("parser"), "event.level", "event.message")


@query
def layered_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events found in all records, and in those that pass the pre-filter."""
    records = with_once(clean_records(spark, sf_dir), "event", extract_event(F.col("line")))
    found = F.col("event").isNotNull()
    return records.agg(
        F.count_if(found).alias("events"),
        F.count_if(found & may_hold_event(F.col("line"))).alias("events_kept"),
    )


@query
def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("stream_key", "seq", F.explode("tags").alias("tag", "value"))
    return rows


@query
def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines to assembled error events: the whole way through."""
    exc = F.col("exception")
    return events(spark, sf_dir).select(
        "stream_key",
        "seq",
        "event_id",
        F.unix_micros("timestamp").alias("timestamp_us"),
        "project_id",
        "platform",
        "level",
        "environment",
        "release",
        "server_name",
        "message",
        exc["type"].alias("exc_type"),
        exc["value"].alias("exc_value"),
        frames_text(exc).alias("frames"),
        F.element_at("tags", "parser").alias("parser"),
        F.element_at("tags", "log_source").alias("log_source"),
    )


# --- ordered and stateful operators ----------------------------------------------


def _record_columns(records: DataFrame) -> DataFrame:
    return records.select("stream_key", "seq", F.unix_micros("ts").alias("micros"), "line", "n_lines")


@query
def recombine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_columns(log_records(spark, sf_dir))


@query
def recombine_hot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as one stream, in buckets far smaller than it."""
    lines = log_lines(spark, sf_dir).withColumn("stream_key", F.lit("all"))
    return _record_columns(recombine(lines, bucket_rows=1000))


@query
def continuation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open a record, under each rule."""
    lines = log_lines(spark, sf_dir).select("stream_key", "seq", "ts", "line")
    parts = [
        recombine(lines, rule).groupBy("stream_key").agg(
            F.lit(rule).alias("rule"),
            F.count("*").alias("records"),
            F.max("n_lines").alias("longest"),
        )
        for rule in RULES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def recombine_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pressed = F.timestamp_micros(
        F.call_function("div", F.unix_micros("ts"), F.lit(TIME_PRESS).cast("bigint"))
    )
    lines = log_lines(spark, sf_dir).withColumn("ts", pressed)
    return _record_columns(recombine(lines, idle_ms=IDLE_MS))


def _event_stream(spark: SparkSession, sf_dir: str) -> None:
    """Make the events a streaming view under the name the derivations use."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream.createOrReplaceTempView("faultline_stream_events")


def _derive_stream(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    _event_stream(spark, sf_dir)
    return spark.sql(sql.replace("@events", "faultline_stream_events"))


@query
def recombine_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the stream; the last ones close when a watermark passes its end."""
    lines = _derive_stream(spark, sf_dir, D.LOG_LINES).select("stream_key", "seq", "ts", "line")
    return _record_columns(recombine_to_the_end(lines))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = derive(spark, sf_dir, D.ARRIVALS_SPARK).withColumn("ts", F.timestamp_micros("micros"))
    return ratelimit.rate_limit(arrivals.drop("micros"), "source", **LIMIT)


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir).select("limiter_key", "seq", "event_type", "allowed")


@query
def rate_limit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bucket for all events, as a single hot key."""
    arrivals = derive(spark, sf_dir, D.ARRIVALS_SPARK).withColumn("ts", F.timestamp_micros("micros"))
    limited = ratelimit.rate_limit(arrivals, F.lit("all"), rate=3, burst=5, block_rows=1000)
    return limited.select("seq", "allowed")


@query
def rate_limit_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = _derive_stream(spark, sf_dir, D.ARRIVALS_SPARK)
    arrivals = arrivals.withColumn("ts", F.timestamp_micros("micros")).drop("micros")
    limited = collect_available(spark, rate_limit_stream(arrivals, "source", **LIMIT))
    return limited.select("limiter_key", "seq", "allowed")


@query
def rate_limit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of which only their batch of a minute is known."""

    def start(batch: Column) -> Column:
        return F.timestamp_micros(batch * D.BATCH_MICROS)

    arrivals = derive(spark, sf_dir, D.BATCHED_ARRIVALS).withColumns(
        {"since": start(F.col("batch")), "ts": start(F.col("batch") + 1)}
    )
    limited = ratelimit.rate_limit(arrivals, "source", **LIMIT, block_rows=1000)
    return limited.select("limiter_key", "batch", "seq", "allowed")


@query
def limiter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ratelimit.limiter_stats(_limited(spark, sf_dir))
    return stats.select("limiter_key", "allowed", "dropped")


@query
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ratelimit.limiter_stats(_limited(spark, sf_dir))
    return stats.select("limiter_key", "sample_rate")


@query
def queue_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, D.QUEUE_SPARK).withColumn("bytes", long("bytes"))
    return queue.retain_newest(entries, RETAIN_BYTES).select("queue", "seq", "bytes")


@query
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, D.QUEUE_SPARK)
    done = queue.replay(entries, F.col("failed"), F.col("corrupt"))
    return done.select("queue", "seq", "action")


@query
def queue_replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, D.QUEUE_SPARK)
    return queue.replay_counts(queue.replay(entries, F.col("failed"), F.col("corrupt")))


@query
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derive(spark, sf_dir, D.QUEUE_NAMES)
    parsed = names.select("queue", "name", queue.entry_seq(F.col("name")).alias("entry_seq"))
    return parsed.where(F.col("entry_seq").isNotNull())


@query
def queue_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derive(spark, sf_dir, D.QUEUE_NAMES)
    arrivals = derive(spark, sf_dir, D.QUEUE_ARRIVALS)
    return queue.enqueue(names, arrivals).select("queue", "seq", long("entry_seq").alias("entry_seq"))


@query
def queue_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.occupancy(derive(spark, sf_dir, D.QUEUE_SPARK), RETAIN_BYTES).select(
        "queue", "entries", long("bytes").alias("bytes"), "cap"
    )


@query
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = delivery.outcomes(derive(spark, sf_dir, D.ATTEMPTS))
    return done.select("event_id", "outcome", "attempts", long("last_status").alias("last_status"))


@query
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = derive(spark, sf_dir, D.ATTEMPTS)
    n = F.col("attempt")
    return tries.select(
        "event_id",
        long("attempt").alias("attempt"),
        delivery.backoff_before(n).alias("wait_seconds"),
        delivery.total_backoff(n).alias("waited_seconds"),
    )


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.source_health(derive(spark, sf_dir, D.REPORTS))


@query
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir)


@query
def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.overall_health(_health(spark, sf_dir))


# --- source code -----------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codechunks.extract_chunks(derive(spark, sf_dir, D.SOURCE_FILES, heavy=True))


@query
def function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "repo", "file_path", "name", long("start_line").alias("start_line"), "language", "content"
    )


@query
def function_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "file_path", long("start_line").alias("start_line"), long("end_line").alias("end_line")
    )


@query
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("repo", "kind").agg(F.count("*").alias("n"))


@query
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "file_path", long("start_line").alias("start_line"), "content_hash"
    )


@query
def chunk_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's chunks as one batch; every 41st batch fails."""
    files = derive(spark, sf_dir, D.SOURCE_FILES, heavy=True)
    number = F.regexp_extract("file_path", r"f(\d+)\.py", 1).cast("bigint")
    batches = (
        codechunks.extract_chunks(files)
        .groupBy("repo", number.alias("batch_no"))
        .agg(F.count("*").alias("chunks"))
        .withColumn("ok", F.col("batch_no") % 41 != 40)
    )
    return codechunks.chunk_accounting(batches).select(
        "repo", long("shipped").alias("shipped"), long("dropped").alias("dropped")
    )


@query
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = derive(spark, sf_dir, D.FRAMES)
    found = codechunks.frame_chunks(frames, _chunks(spark, sf_dir))
    return found.select(
        "event_id",
        "filename",
        "lineno",
        "chunk_name",
        "chunk_kind",
        long("chunk_start_line").alias("chunk_start_line"),
        long("chunk_end_line").alias("chunk_end_line"),
    )
