"""Whole jobs, from log files to delivered events."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from faultline.operators.layered import assemble, scrub_and_extract
from faultline.plans.event_job import find_events, limit_events, run_batch, start_stream
from faultline.sources.text import file_source
from faultline.sources.union import union_sources
from faultline.streaming.sink import collect_available

LOG = """INFO started
Traceback (most recent call last):
  File "/app/x.py", line 42, in foo
    raise RuntimeError("boom")
RuntimeError: mail bob@example.com
INFO next request started
{"level":"error","message":"db down","error":"gone"}
java.lang.IllegalStateException: bad
\tat com.example.Foo.bar(Foo.java:42)
2026-01-01 FATAL out of space
"""


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(LOG)
    return folder


def expected():
    return {
        ("python", "RuntimeError: mail [email]"),
        ("json", "db down"),
        ("java", "java.lang.IllegalStateException: bad"),
        ("fallback", "2026-01-01 FATAL out of space"),
    }


def test_batch(spark, logs, tmp_path):
    run_batch(file_source(spark, str(logs)), "p", str(tmp_path / "out"))
    bodies = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {(b["tags"]["parser"], b["message"]) for b in bodies} == expected()
    assert all(b["project_id"] == "p" and b["tags"]["log_source"] == "file" for b in bodies)
    # The same logs give the same ids again.
    again = find_events(file_source(spark, str(logs)), "p")
    assert {r.event_id for r in again.collect()} == {b["event_id"] for b in bodies}


def test_batch_delivers_every_event_of_an_archive(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"ERROR number {i}\n" for i in range(1500)))
    raw = file_source(spark, str(folder))
    run_batch(raw, "p", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1500
    run_batch(raw, "p", str(tmp_path / "limited"), rate=1, burst=20)
    assert spark.read.text(str(tmp_path / "limited")).count() == 20


def test_a_time_in_a_record_changes_no_verdict(spark):
    """The limiter runs on arrivals; a record of the year 9999 is one event like others."""

    def verdicts(year):
        at = "2026-01-01 00:00:00"
        rows = [(i, '{"level":"error","message":"m%d","timestamp":"%s-01-01T00:00:00Z"}' % (i, year if i == 3 else 2026)) for i in range(60)]
        records = spark.createDataFrame(rows, "seq long, line string").selectExpr(
            "'s' as stream_key", "'file' as source", "seq", "line",
            f"timestamp'{at}' + make_interval(0,0,0,0,0,0,cast(seq as decimal(18,6))) as ts", "map('a','b') as tags",
        )
        events = assemble(scrub_and_extract(records), "p", arrival=True)
        return sorted(r.seq for r in limit_events(events, rate=1, burst=5).collect())

    assert verdicts(9999) == verdicts(2026) == list(range(60))


def test_limit(spark, logs):
    events = find_events(file_source(spark, str(logs)), "p", arrival=True)
    kept = limit_events(events, F.lit("all"), rate=1, burst=2, mark=True).collect()
    assert len(kept) == 2
    assert {r.tags["sampled"] for r in kept} == {"1/2"}
    assert len(limit_events(events, F.lit("all"), rate=1, burst=2).collect()) == 2


def test_custom_keyword_may_match_a_marker(spark, logs):
    events = find_events(file_source(spark, str(logs)), "p", keywords=["[EMAIL]", "OUT OF"])
    got = {(r.tags["parser"], r.message) for r in events.collect()}
    assert got == expected()


def test_stream(spark, logs, tmp_path):
    raw = file_source(spark, str(logs), streaming=True)
    query = start_stream(raw, "p", str(tmp_path / "out"), str(tmp_path / "cp"), trigger_ms=250)
    got = set()
    try:
        deadline = time.time() + 120
        while time.time() < deadline and got != expected():
            time.sleep(1)
            assert query.exception() is None
            if (tmp_path / "out").exists() and list((tmp_path / "out").glob("run=*/batch=*/*.parquet")):
                rows = spark.read.parquet(str(tmp_path / "out") + "/*/*").collect()
                got = {(r.tags["parser"], r.message) for r in rows}
    finally:
        query.stop()
    assert got == expected()


def shared(spark, folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)
        os.utime(folder / name, (10**9, 10**9))
    return union_sources(spark, [{"type": "journald", "paths": [str(folder / "*.json")]}])


def entry(unit, message):
    return json.dumps({"_SYSTEMD_UNIT": unit, "MESSAGE": message}) + "\n"


def test_origins_that_share_a_stream(spark, tmp_path):
    """Two journals of one unit: no trace is torn, a rate fails no job, a new file changes no id."""
    trace = "".join(entry("app", line) for line in ["panic: boom", "", "goroutine 1 [running]:", "main.f()", "\t/a.go:3"])
    plain = "".join(entry("app", f"ERROR same {k % 2}") for k in range(6))
    raw = shared(spark, tmp_path / "j", {"b.json": plain + trace, "c.json": trace + plain})
    before = {r.event_id: r.message for r in find_events(raw, "p").collect()}
    assert len(before) == 14
    assert sorted(before.values()).count("panic: boom") == 2
    raw = shared(spark, tmp_path / "j", {"a.json": plain * 50})
    after = {r.event_id: r.message for r in find_events(raw, "p").collect()}
    assert len(after) == 14 + 300 and before.items() <= after.items()
    run_batch(raw, "p", str(tmp_path / "out"), rate=1, burst=20)
    assert spark.read.text(str(tmp_path / "out")).count() == 20


def test_stream_rows_are_numbered_in_their_file(spark, tmp_path):
    """Positions rise along a file however it is split, also where every line is empty."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.log").write_text("\n" * 5000)
    (tmp_path / "in" / "a.log").write_text("".join(f"line {k}\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = collect_available(spark, file_source(spark, str(tmp_path / "in"), streaming=True)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, n in (("empty.log", 5000), ("a.log", 3000)):
        own = sorted((r.seq, r.line) for r in got if r.origin.endswith("/" + name))
        assert len({seq for seq, _ in own}) == n
        if name == "a.log":
            assert [line for _, line in own] == [f"line {k}" for k in range(n)]
