"""Streams give what the batch operators give."""

import datetime as dt
import time

import pytest

from faultline.operators.ratelimit import rate_limit
from faultline.operators.recombine import recombine
from faultline.sources.text import file_source
from faultline.streaming.limiter import BatchLimiter, rate_limit_stream
from faultline.streaming.records import recombine_stream, recombine_to_the_end
from faultline.sources.containers import container_source
from faultline.sources.otlp import otlp_source
from faultline.sources.union import union_sources
from faultline.streaming.containers import CHUNK_SCHEMA, container_stream
from faultline.streaming.sink import collect_available, run_available

SCHEMA = "stream_key string, seq bigint, ts timestamp, line string, tags map<string,string>"
T0 = dt.datetime(2026, 1, 1)
LINES = [
    "Traceback (most recent call last):", '  File "/a.py", line 1, in f', "    x",
    "ValueError: bad", "INFO ok", "panic: z", "", "goroutine 1 [running]:", "plain", "  more",
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Log lines in six files, each one batch of a stream."""
    folder = tmp_path_factory.mktemp("lines")
    rows = [
        (f"k{i % 3}", i, T0 + dt.timedelta(milliseconds=170 * i), LINES[(i // 3) % len(LINES)], {"n": str(i)})
        for i in range(180)
    ]
    for part in range(6):
        df = spark.createDataFrame(rows[part * 30 : part * 30 + 30], SCHEMA).repartition(3)
        df.coalesce(1).write.mode("append").parquet(str(folder / "p"))
        time.sleep(0.05)
    return str(folder / "p")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def key(r):
    return (r.stream_key, r.seq, r.ts, r.line, r.n_lines, tuple(sorted(r.tags.items())))


@pytest.mark.parametrize("gaps", [False, True])
def test_records(spark, parts, gaps):
    batch = recombine(spark.read.schema(SCHEMA).parquet(parts), idle_ms=500 if gaps else None)
    want = sorted(map(key, batch.collect()))
    last = {k: max(w for w in want if w[0] == k) for k in ("k0", "k1", "k2")}
    got = collect_available(
        spark, recombine_stream(stream(spark, parts), time_mode="None", event_gaps=gaps)
    )
    assert sorted(map(key, got.collect())) == [w for w in want if w not in last.values()]


def test_idle_timer_closes_the_last_record(spark, parts, tmp_path):
    records = recombine_stream(stream(spark, parts), idle_ms=300)
    query = (
        records.writeStream.format("memory").queryName("idle_records").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds")
        .start()
    )
    try:
        want = sorted(
            k[:2] + k[3:] for k in map(key, recombine(spark.read.schema(SCHEMA).parquet(parts)).collect())
        )
        lines = "\n".join(sorted("\n".join(k[2] for k in want).split("\n")))
        deadline = time.time() + 90
        got = []
        while time.time() < deadline:
            got = [k[:2] + k[3:] for k in map(key, spark.table("idle_records").collect())]
            if "\n".join(sorted("\n".join(k[2] for k in got).split("\n"))) == lines:
                break
            time.sleep(0.5)
        # A slow batch may also close a record early; no line is lost or doubled.
        assert "\n".join(sorted("\n".join(k[2] for k in got).split("\n"))) == lines
        assert sum(k[3] for k in got) == 180
    finally:
        query.stop()


def test_limiter(spark, parts):
    events = spark.read.schema(SCHEMA).parquet(parts)
    want = rate_limit(events, "stream_key", rate=1, burst=3)
    got = collect_available(
        spark, rate_limit_stream(stream(spark, parts), "stream_key", rate=1, burst=3)
    )
    def verdicts(df):
        return sorted((r.limiter_key, r.seq, r.allowed) for r in df.collect())

    assert verdicts(got) == verdicts(want)
    assert {v[2] for v in verdicts(got)} == {True, False}


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ERROR x\n  more\n")
    got = collect_available(spark, file_source(spark, str(tmp_path / "in"), streaming=True))
    assert [r.line for r in got.orderBy("seq").collect()] == ["ERROR x", "  more"]


def test_watermark_closes_records(spark, parts):
    """In event time a record closes once the watermark is past its idle time."""
    lines = stream(spark, parts).withWatermark("ts", "0 seconds")
    got = collect_available(spark, recombine_stream(lines, idle_ms=500, time_mode="EventTime"))
    batch = recombine(spark.read.schema(SCHEMA).parquet(parts), idle_ms=500)
    want = set(map(key, batch.collect()))
    rows = list(map(key, got.collect()))
    assert len(rows) == len(set(rows))
    assert set(rows) <= want
    # Only records near the end, which no watermark has passed yet, may still be open.
    late = max(k[2] for k in want) - dt.timedelta(seconds=3)
    assert {k for k in want if k[2] < late} <= set(rows)


def test_container_stream(spark, tmp_path):
    chunks = [
        ("1", ["/web"], i, T0 + dt.timedelta(seconds=i), p) for i, p in enumerate(["ab", "c\nde\nf", "g\n", "", "\n\nx", "y\ntail"])
    ] + [("2", ["/db"], i, None, "line %d\nhalf " % i) for i in range(6)]
    for i in range(6):
        part = spark.createDataFrame([c for c in chunks if c[2] == i], CHUNK_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        time.sleep(0.05)
    source = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", 2).parquet(
        str(tmp_path / "c")
    )

    def lines(df):
        return sorted((r.tags["container_name"], r.seq, r.line, str(r.ts)) for r in df.collect())

    got = lines(collect_available(spark, container_stream(source)))
    assert got == lines(container_source(spark.createDataFrame(chunks, CHUNK_SCHEMA)))
    assert ("web", 0, "abc", str(T0 + dt.timedelta(seconds=1))) in got


def test_union_of_streams(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    (tmp_path / "otlp").mkdir()
    record = '{"body":{"stringValue":"%s"}}'
    request = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[%s]}]}]}\n'
    body = "".join(
        request % ",".join(record % f"r{i}.{j}" for j in range(3)) for i in range(4)
    )
    (tmp_path / "otlp" / "o.json").write_text(body)
    raw = union_sources(
        spark,
        [
            {"type": "file", "paths": [str(tmp_path / "logs")], "streaming": True},
            {"type": "otel", "paths": [str(tmp_path / "otlp")], "streaming": True},
        ],
    )
    rows = collect_available(spark, raw).collect()
    assert [r.line for r in sorted((r for r in rows if r.source == "file"), key=lambda r: r.seq)] == [
        "one", "two",
    ]
    otel = sorted((r for r in rows if r.source == "otel"), key=lambda r: r.seq)
    assert [r.line for r in otel] == [f"r{i}.{j}" for i in range(4) for j in range(3)]
    assert len({r.seq for r in otel}) == 12
    batch = otlp_source(spark, str(tmp_path / "otlp")).collect()
    assert [r.line for r in sorted(batch, key=lambda r: r.seq)] == [r.line for r in otel]


def test_a_new_checkpoint_erases_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    for run in ("first", "second"):
        stream = file_source(spark, str(tmp_path / "in"), streaming=True)
        run_available(stream, str(tmp_path / "out"), str(tmp_path / run))
    assert spark.read.parquet(str(tmp_path / "out") + "/*/*").count() == 4
    run_available(file_source(spark, str(tmp_path / "in"), streaming=True), str(tmp_path / "out"), str(tmp_path / "first"))
    assert spark.read.parquet(str(tmp_path / "out") + "/*/*").count() == 4


def test_batch_limiter(spark, tmp_path):
    """Batches of a minute: a steady stream passes whole, a flood at the rate, a batch run again the same."""
    limiter = BatchLimiter(str(tmp_path / "buckets"), "stream_key", rate=100, burst=500, trigger_ms=60_000, clock=lambda: 0)

    def passed(batch, minute, counts):
        now = T0 + dt.timedelta(minutes=minute)
        rows = [(k, i, now) for k, n in counts.items() for i in range(n)]
        got = limiter(spark.createDataFrame(rows, "stream_key string, seq long, ts timestamp").persist(), batch)
        seqs = {}
        for r in got.where("allowed").collect():
            seqs.setdefault(r.stream_key, []).append(r.seq)
        assert all(sorted(v) == list(range(len(v))) for v in seqs.values())
        return {k: len(v) for k, v in seqs.items()}

    assert passed(0, 0, {"backlog": 3000}) == {"backlog": 500}
    for batch in range(1, 6):
        got = passed(batch, batch, {"steady": 3000, "flood": 12_000, None: 1})
        assert got == {"steady": 3000, "flood": 6500 if batch == 1 else 6000, None: 1}
        assert passed(batch, batch, {"steady": 3000, "flood": 12_000}) == {k: v for k, v in got.items() if k}
    # Nothing for an hour: what comes then has come within one trigger.
    assert passed(6, 66, {"steady": 50_000, "new": 50_000}) == {"steady": 6500, "new": 6500}
    assert passed(7, 67, {}) == {}
    assert passed(8, 67, {"steady": 7000}) == {"steady": 6000}


def test_the_end_closes_every_record(spark, parts):
    """Nothing stays open: the same records as of a batch, with and without gaps."""
    for gaps in (False, True):
        batch = recombine(spark.read.schema(SCHEMA).parquet(parts), idle_ms=500 if gaps else None)
        whole = spark.readStream.schema(SCHEMA).parquet(parts)
        got = recombine_to_the_end(whole, idle_ms=500, event_gaps=gaps)
        assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))
