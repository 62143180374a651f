"""Extraction layers on complete records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators.fallback import fallback_event
from faultline.operators.json_events import json_event
from faultline.operators.layered import LAYERS, assemble, extract, extract_event, may_hold_event, scrub_and_extract
from faultline.operators.traces import (
    go_event,
    java_event,
    node_event,
    python_event,
    ruby_event,
)
from faultline.plans.queries import short_fallback
from faultline.schema import EVENT, RAW_LOG


def run(spark, extractor, text):
    df = spark.createDataFrame([(text,)], "line string")
    row = df.select(extractor(F.col("line")).alias("e")).first()
    return None if row.e is None else row.e.asDict(recursive=True)


def frames(event):
    return event["exception"]["stacktrace"]["frames"]


DJANGO = """Traceback (most recent call last):
  File "/app/views.py", line 47, in create_order
    customer = Customer.objects.get(id=customer_id)
  File "/usr/lib/python3.11/site-packages/django/db/manager.py", line 87, in manager_method
    return getattr(self.get_queryset(), name)(*args, **kwargs)
django.core.exceptions.ObjectDoesNotExist: Customer matching query does not exist."""


def test_json_nested(spark):
    e = run(
        spark,
        json_event,
        '{"level":"error","message":"db down","exception":{"type":"OperationalError",'
        '"value":"could not connect","stacktrace":{"frames":[{"filename":"db.py",'
        '"function":"connect","lineno":42}]}},"timestamp":"2026-04-26T12:00:00Z",'
        '"environment":"prod","release":"v1.2.3"}',
    )
    assert (e["parser"], e["level"], e["message"]) == ("json", "error", "db down")
    assert e["exception"]["type"] == "OperationalError"
    assert e["exception"]["value"] == "could not connect"
    assert frames(e) == [
        {"filename": "db.py", "function": "connect", "lineno": 42, "context_line": None}
    ]
    assert (e["environment"], e["release"]) == ("prod", "v1.2.3")
    assert e["platform"] == "unknown"


def test_json_flat(spark):
    e = run(
        spark,
        json_event,
        '{"level":"error","msg":"request failed","error":"ENOENT: no such file","logger":"express"}',
    )
    assert e["message"] == "request failed"
    assert e["exception"] == {
        "type": "Error",
        "value": "ENOENT: no such file",
        "stacktrace": None,
    }
    assert e["platform"] == "node"


@pytest.mark.parametrize(
    "line, level",
    [
        ('{"severity":"ERROR","message":"timeout"}', "error"),
        ('  {"level":"CRIT"}  ', "fatal"),
        ('{"level":" Err "}', "error"),
        ('{"level":"info","level":"error"}', "error"),
        ('{"level":"","severity":"fatal"}', "fatal"),
        ('{"level":50,"severity":"error"}', "error"),
        ('{"level":"\\u0065rror"}', "error"),
        ('{"lineno":1e300,"level":"error","exception":{"type":"E","stacktrace":{"frames":'
         '[{"lineno":1e300}]}}}', "error"),
    ],
)
def test_json_levels(spark, line, level):
    assert run(spark, json_event, line)["level"] == level


@pytest.mark.parametrize(
    "line",
    [
        '{"level":"info","message":"healthcheck ok"}',
        "plain text log line",
        "",
        "{ not valid json",
        '["array", "not", "object"]',
        '{"level":"error"} x',
        '{"level":"error"},{"level":"error"}',
        '{"level":50}',
        "{'level':'error'}",
        '{"level":"error\tx"}',
    ],
)
def test_json_none(spark, line):
    assert run(spark, json_event, line) is None


def test_json_own_time(spark):
    def own(text):
        line = '{"level":"error","timestamp":"%s"}' % text
        df = spark.createDataFrame([(line,)], "line string")
        return df.select(json_event(F.col("line"))["own_ts"].alias("t")).select(
            F.unix_micros("t").alias("u")
        ).first().u

    base = int(dt.datetime(2026, 1, 15, 10, 30, 45, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert own("2026-01-15T10:30:45Z") == base
    assert own("2026-01-15T12:30:45.25+02:00") == base + 250000
    assert own("2026-01-15T10:30:45.123456789Z") == base + 123456
    assert own("2026-01-15") is None
    assert own("2026-01-15 10:30:45Z") is None
    assert own("2026-13-15T10:30:45Z") is None


def test_json_frames(spark):
    e = run(
        spark,
        json_event,
        '{"level":"error","exception":{"class":"X","stacktrace":{"frames":[3,{"file":"a",'
        '"func":"f","lineno":7.9,"code":"c"},"s",{"lineno":"8","method":"m"}]}}}',
    )
    assert frames(e) == [
        {"filename": "a", "function": "f", "lineno": 7, "context_line": "c"},
        {"filename": "", "function": "m", "lineno": None, "context_line": None},
    ]
    e = run(spark, json_event, '{"level":"error","exception":{"type":"X","stacktrace":{"frames":1}}}')
    assert e["exception"]["stacktrace"] is None
    e = run(spark, json_event, '{"level":"error","exception":{"stacktrace":{"frames":[]}},"err":"z"}')
    assert e["exception"] == {"type": "Error", "value": "z", "stacktrace": None}


def test_python(spark):
    e = run(spark, python_event, DJANGO)
    assert e["exception"]["type"] == "django.core.exceptions.ObjectDoesNotExist"
    assert e["message"].endswith("Customer matching query does not exist.")
    assert frames(e)[0] == {
        "filename": "/app/views.py",
        "function": "create_order",
        "lineno": 47,
        "context_line": "customer = Customer.objects.get(id=customer_id)",
    }
    assert len(frames(e)) == 2
    # Frames alone are enough; a marker alone is not.
    e = run(spark, python_event, "  x Traceback (most recent call last):\n" + DJANGO.split("\n")[1])
    assert e["message"] == "x Traceback (most recent call last):"
    assert (e["exception"]["type"], len(frames(e))) == ("", 1)
    assert frames(e)[0]["context_line"] is None
    assert run(spark, python_event, "Traceback (most recent call last):\n  nothing") is None
    assert run(spark, python_event, "ValueError: x") is None
    long_name = "a" + ".b" * 100_000
    e = run(spark, python_event, f"Traceback (most recent call last):\n{long_name}: x")
    assert e["exception"]["type"] == long_name
    # Frames after the exception line are not part of it.
    e = run(spark, python_event, DJANGO + "\n" + DJANGO.split("\n")[1])
    assert len(frames(e)) == 2


def test_java(spark):
    e = run(
        spark,
        java_event,
        'java.lang.NullPointerException: Cannot invoke "String.length()"\n'
        "\tat com.example.Foo.bar(Foo.java:42)\n\tat com.example.Foo.main(Foo.java:18)",
    )
    assert e["exception"]["type"] == "java.lang.NullPointerException"
    assert [(f["function"], f["lineno"]) for f in frames(e)] == [
        ("com.example.Foo.bar", 42),
        ("com.example.Foo.main", 18),
    ]
    e = run(
        spark,
        java_event,
        'x\nException in thread "main" java.io.IOException\n  at a.B.c(Native Method)\n  ... 5 more\n'
        "Caused by: java.lang.Error: disk\n  at app//d.E.f(E.java:9)\n\nend\n  at g.H.i(H.java:1)",
    )
    assert e["message"] == e["exception"]["type"] == "java.io.IOException"
    assert [(f["filename"], f["lineno"]) for f in frames(e)] == [
        ("Native Method", None),
        ("E.java", 9),
    ]
    assert run(spark, java_event, "java.lang.NullPointerException: foo") is None


def test_go(spark):
    e = run(
        spark,
        go_event,
        "panic: runtime error: index out of range [5] with length 3\n\ngoroutine 1 [running]:\n"
        "main.processOrders(0xc00009a000)\n\t/app/main.go:42 +0x123\nmain.main()\n\t/app/main.go:18 +0x52\n"
        "main.(*T).m(1)\nexit status 2",
    )
    assert e["exception"]["type"] == "PanicError"
    assert [(f["function"], f["filename"], f["lineno"]) for f in frames(e)] == [
        ("main.processOrders", "/app/main.go", 42),
        ("main.main", "/app/main.go", 18),
    ]
    e = run(spark, go_event, "fatal error: concurrent map writes")
    assert e["exception"]["type"] == "FatalError"
    assert e["message"] == "panic: concurrent map writes"
    assert frames(e) == []
    assert run(spark, go_event, "do not panic: x") is None


def test_node(spark):
    e = run(
        spark,
        node_event,
        "  TypeError: Cannot read property 'name' of undefined\n"
        "    at Object.<anonymous> (/app/server.js:42:18)\n"
        "    at Module._compile (internal/loader.js:1063:30)\n    at /app/lib/foo.js:10:5\n"
        "    at native\n    at z (q.js:1:2)\nend\n    at y (q.js:1:2)",
    )
    assert e["exception"]["type"] == "TypeError"
    assert [(f["function"], f["filename"], f["lineno"]) for f in frames(e)] == [
        ("Object.<anonymous>", "/app/server.js", 42),
        ("Module._compile", "internal/loader.js", 1063),
        ("<anonymous>", "/app/lib/foo.js", 10),
        ("z", "q.js", 1),
    ]
    assert run(spark, node_event, "Error: something went wrong") is None


def test_ruby(spark):
    e = run(
        spark,
        ruby_event,
        "noise\n/app/lib/foo.rb:42:in `bar': could not connect (ConnectionError)\n"
        "  from /app/lib/baz.rb:18:in `init'\n\tfrom /app/main.rb:5:in `<main>'\nx\n  from /a.rb:1:in `z'",
    )
    assert e["exception"]["type"] == "ConnectionError"
    assert e["exception"]["value"] == "could not connect"
    assert [(f["filename"], f["lineno"], f["function"]) for f in frames(e)] == [
        ("/app/lib/foo.rb", 42, "bar"),
        ("/app/lib/baz.rb", 18, "init"),
        ("/app/main.rb", 5, "<main>"),
    ]
    e = run(spark, ruby_event, "a.rb:1:in `f': gone (ActiveRecord::RecordNotFound)")
    assert e["exception"]["type"] == "ActiveRecord::RecordNotFound"
    assert len(frames(e)) == 1
    assert run(spark, ruby_event, "a.rb:1: nothing") is None


def test_fallback(spark):
    for line in ("ERROR x", "a fatal b", "kernel Panic", "some exception", "traceback"):
        assert run(spark, fallback_event, line)["tags"] == {"raw_line": line}
    for line in ("INFO fine", "warning", ""):
        assert run(spark, fallback_event, line) is None
    e = run(spark, short_fallback, " " + "x" * 10000 + " ERROR boom")
    assert e["message"] == "x" * 8000
    assert e["tags"]["raw_line"] == " " + "x" * 199

    def custom(c):
        return fallback_event(c, ["BOOM", "quiet"])

    assert run(spark, custom, "boom") is not None
    assert run(spark, custom, "ERROR quiet") is None


@pytest.mark.parametrize("shift", range(5))
def test_fallback_cuts_bytes(spark, shift):
    text = "e" * shift + "error " + "😀é" * 2000
    want = text.encode()[:8000].decode("utf-8", "surrogateescape")
    want = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in want)
    assert run(spark, short_fallback, text)["message"] == want


def test_layers(spark):
    assert run(spark, extract_event, '{"level":"info","error":null}')["parser"] == "fallback"
    assert run(spark, extract_event, '{"level":"error"}')["parser"] == "json"
    assert run(spark, extract_event, "INFO ok") is None
    both = DJANGO + "\n/a.rb:1:in `f': m (E)"
    assert run(spark, extract_event, both)["parser"] == "python"
    assert run(spark, extract_event, "  {\"level\":\"error\"}　")["parser"] == "json"


def test_assemble_tags_and_prefilter(spark):
    rows = [
        ("file", 1, dt.datetime(2026, 1, 1), "ERROR x", {"file_path": "/a", "parser": "mine"}),
        ("file", 2, dt.datetime(2026, 1, 1), "INFO x", {}),
        ("file", 3, dt.datetime(2026, 1, 1), "THROWABLE in :in `", None),
        ("file", 5, dt.datetime(2026, 1, 1), '{"level":"\\u0065rr"}', {}),
        ("file", 4, dt.datetime(2026, 1, 1), "a.rb:1:in `f': gone (E)", {"log_source": "no"}),
    ]
    df = spark.createDataFrame(rows, RAW_LOG).withColumn("stream_key", F.lit("k"))
    results = [
        {
            r.seq: r
            for r in assemble(extract(df, prefilter=on), "p").collect()
        }
        for on in (True, False)
    ]
    assert results[0] == results[1]
    got = results[0]
    assert set(got) == {1, 4, 5}
    assert got[1].tags == {
        "raw_line": "ERROR x",
        "parser": "mine",
        "file_path": "/a",
        "log_source": "file",
    }
    assert got[4].tags == {"parser": "ruby", "log_source": "file"}
    assert len(got[1].event_id) == 36
    assert got[1].project_id == "p"
    assert df.where(may_hold_event(F.col("line"))).count() == 4


def test_layers_of_ones_own(spark):
    def oops(text):
        missing = [F.lit(None)] * 5
        event = F.struct(F.lit("oops"), F.lit("x"), F.lit("error"), text, *missing, F.create_map(F.lit("a"), F.lit("b")))
        return F.when(text.startswith("OOPS"), event.cast(EVENT))

    rows = [(1, "OOPS it broke"), (2, "all is fine"), (3, "FATAL end")]
    df = spark.createDataFrame(rows, "seq bigint, line string")
    gate = lambda text: text.startswith("OOPS")
    for layer in (("oops", oops), ("oops", oops, gate)):
        for found in (extract(df, (*LAYERS, layer)), scrub_and_extract(df, layers=(layer, *LAYERS))):
            got = {r.seq: r.parser for r in found.select("seq", "event.parser").collect()}
            assert got == {1: "oops", 3: "fallback"}


def test_fallback_keeps_whole_texts(spark):
    text = "ERROR " + "é" * 9000
    df = spark.createDataFrame([(1, text)], "seq bigint, line string")
    whole, short = df.select(fallback_event(F.col("line")), fallback_event(F.col("line"), (), 8000, 200)).first()
    assert whole.message == whole.tags["raw_line"] == text
    assert len(short.message.encode()) <= 8000 and len(short.tags["raw_line"].encode()) <= 200
