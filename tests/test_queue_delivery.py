"""Retry queue, delivery outcomes and health against small plain folds."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.delivery import backoff_before, outcomes, total_backoff
from faultline.operators.health import overall_health, source_health
from faultline.operators.layered import assemble, extract
from faultline.operators.queue import (
    enqueue,
    entry_name,
    entry_seq,
    occupancy,
    replay,
    replay_counts,
    retain_newest,
)
from faultline.operators.scan import with_totals_before
from faultline.schema import RAW_LOG
from faultline.sources.sinks import envelope_json, queue_rows, write_events


@pytest.mark.parametrize("bucket_rows", [1, 3, 1 << 20])
@pytest.mark.parametrize("descending", [False, True])
def test_totals_before(spark, bucket_rows, descending):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), s, rng.randint(0, 9)) for s in range(-40, 40)]
    df = spark.createDataFrame(rows, "k string, s bigint, v bigint").repartition(4)
    out = with_totals_before(
        df,
        ["k"],
        "s",
        sums={"t": F.col("v")},
        maxima={"m": F.col("v")},
        bucket_rows=bucket_rows,
        descending=descending,
    )
    got = {(r.k, r.s): (r.t, r.m) for r in out.collect()}
    assert len(got) == len(rows)
    for k, s, _ in rows:
        past = [v for k2, s2, v in rows if k2 == k and (s2 > s if descending else s2 < s)]
        assert got[k, s] == (sum(past), max(past, default=None))


def enqueue_all(sizes, cap):
    """Evict the oldest until each new entry fits."""
    kept = []
    for seq, size in enumerate(sizes):
        while kept and sum(s for _, s in kept) + size > cap:
            kept.pop(0)
        kept.append((seq, size))
    return [s for s, _ in kept]


@pytest.mark.parametrize("bucket_rows", [2, 1 << 20])
def test_retention(spark, bucket_rows):
    rng = random.Random(3)
    queues = {"doc": [200, 200, 200, 90], "over": [10, 900], "under": [900, 10]}
    for i in range(12):
        queues[f"r{i}"] = [rng.randint(1, 260) for _ in range(rng.randint(1, 30))]
    rows = [(q, s, b) for q, sizes in queues.items() for s, b in enumerate(sizes)]
    df = spark.createDataFrame(rows, "queue string, seq bigint, bytes bigint")
    got = {}
    for r in retain_newest(df, 500, bucket_rows=bucket_rows).collect():
        got.setdefault(r.queue, []).append(r.seq)
    assert {q: sorted(s) for q, s in got.items()} == {
        q: enqueue_all(sizes, 500) for q, sizes in queues.items()
    }
    assert sorted(got["doc"]) == [1, 2, 3]
    assert got["over"] == [1]


def test_replay(spark):
    queues = {
        "abc": ["ok", "fail", "ok"],
        "corrupt": ["ok", "bad", "ok"],
        "later": ["bad", "fail", "bad", "ok", "fail"],
        "both": ["badfail", "ok"],
    }
    rows = [(q, s, v) for q, vs in queues.items() for s, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "queue string, seq bigint, v string")
    done = replay(df, F.contains("v", F.lit("fail")), F.startswith("v", F.lit("bad")))
    got = {}
    for r in done.orderBy("queue", "seq").collect():
        got.setdefault(r.queue, []).append(r.action)
    rest, ok, gone = "remaining", "delivered", "discarded"
    assert got == {
        "abc": [ok, rest, rest],
        "corrupt": [ok, gone, ok],
        "later": [gone, rest, rest, rest, rest],
        "both": [gone, ok],
    }
    counts = {r.queue: (r.delivered, r.discarded, r.remaining) for r in replay_counts(done).collect()}
    assert counts["abc"] == (1, 0, 2)
    assert counts["corrupt"] == (2, 1, 0)


def test_names_and_resume(spark):
    good = "00000000000000000042.json"
    names = [good, good + ".tmp", "x" + good[1:], "42.json", "0" * 19 + "7.json"]
    df = spark.createDataFrame([("q", n) for n in names] + [("none", "x")], "queue string, name string")
    seqs = {r.name: r.s for r in df.select("name", entry_seq(F.col("name")).alias("s")).collect()}
    assert [seqs[n] for n in names] == [42, None, None, None, 7]
    assert df.select(entry_name(F.lit(42)).alias("n")).first().n == good
    arrivals = spark.createDataFrame(
        [("q", 5), ("q", 9), ("none", 1), ("new", 0), ("new", 3)], "queue string, seq bigint"
    )
    for width in (1, 1 << 20):
        got = {(r.queue, r.seq): r.entry_seq for r in enqueue(df, arrivals, bucket_rows=width).collect()}
        assert got == {("q", 5): 43, ("q", 9): 44, ("none", 1): 1, ("new", 0): 1, ("new", 3): 2}


def test_occupancy(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5)], "queue string, bytes bigint")
    got = {r.queue: (r.entries, r.bytes, r.cap) for r in occupancy(df, 10).collect()}
    assert got == {"a": (2, 7, 10), "b": (1, 5, 10)}


def test_outcomes(spark):
    tries = {
        "third": [500, 500, 201],
        "rejected": [400],
        "first": [201, 500],
        "network": [None, 204],
        "spent": [500] * 6 + [200],
        "waiting": [503, None],
        "redirect": [302, 199, 404],
    }
    rows = [(e, i + 1, s) for e, ss in tries.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "event_id string, attempt int, status int").repartition(3)
    got = {r.event_id: (r.outcome, r.attempts, r.last_status) for r in outcomes(df).collect()}
    assert got == {
        "third": ("delivered", 3, 201),
        "rejected": ("permanent", 1, 400),
        "first": ("delivered", 1, 201),
        "network": ("delivered", 2, 204),
        "spent": ("exhausted", 6, 500),
        "waiting": ("pending", 2, None),
        "redirect": ("permanent", 3, 404),
    }


def test_backoff(spark):
    df = spark.range(1, 12)
    got = df.select(backoff_before(F.col("id")).alias("w"), total_backoff(F.col("id")).alias("t"))
    waits = [0, 1, 2, 4, 8, 16, 32, 60, 60, 60, 60]
    rows = got.collect()
    assert [r.w for r in rows] == waits
    assert [r.t for r in rows] == [sum(waits[: i + 1]) for i in range(11)]
    high = spark.range(900, 901).select(backoff_before(F.col("id"), 7, 5000).alias("w")).first()
    assert high.w == 5000
    assert spark.range(2, 3).select(backoff_before(F.col("id"), 70, 60).alias("w")).first().w == 70


def test_health(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [
        ("a", 3, 1, None, None),
        ("a", 4, 0, "old", at),
        ("b", 1, 1, "older", at),
        ("b", 1, 1, "disk", at + dt.timedelta(seconds=1)),
        ("c", 1, 0, "gone", at),
        ("c", 1, 0, "", at + dt.timedelta(seconds=1)),
        ("d", 2, 0, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "source string, emitted bigint, dropped bigint, last_error string, last_error_at timestamp",
    )
    health = source_health(df)
    got = {r.source: (r.healthy, r.emitted, r.dropped, r.last_error) for r in health.collect()}
    assert got == {
        "a": (False, 7, 1, "old"),
        "b": (False, 2, 2, "disk"),
        "c": (True, 2, 0, None),
        "d": (True, 2, 0, None),
    }
    assert overall_health(health).first().asDict() == {
        "status": "degraded",
        "sources": 4,
        "unhealthy": 2,
    }
    assert overall_health(health.where("healthy")).first().status == "ok"
    assert overall_health(health.where("1=0")).first().status == "ok"


def test_envelope_json(spark, tmp_path):
    rows = [
        ("file", 1, dt.datetime(2026, 1, 1, 1, 2, 3, 4000), "ERROR x", {"file_path": "/a"}),
        ("file", 2, dt.datetime(2026, 1, 1), "panic: y\n\na.b()", {}),
    ]
    df = spark.createDataFrame(rows, RAW_LOG).withColumn("stream_key", F.lit("k"))
    events = assemble(extract(df), "p")
    bodies = [json.loads(r.b) for r in events.orderBy("seq").select(envelope_json().alias("b")).collect()]
    assert set(bodies[0]) == {
        "event_id", "timestamp", "project_id", "platform", "level", "message", "tags",
    }
    assert bodies[0]["timestamp"] == "2026-01-01T01:02:03.004000Z"
    assert bodies[1]["exception"] == {
        "type": "PanicError",
        "value": "y",
        "stacktrace": {"frames": [{"filename": "", "function": "a.b"}]},
    }
    queued = queue_rows(events, "q").collect()
    assert all(r.bytes == len(r.body.encode()) for r in queued)
    write_events(events, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == 2
    assert {r.project_id for r in back.collect()} == {"p"}
