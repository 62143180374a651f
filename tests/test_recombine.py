"""Recombination against a line-by-line fold, over many bucket sizes."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators.recombine import RULES, recombine, stream_key

T0 = dt.datetime(2026, 1, 1)
VOCABULARY = [
    "INFO started",
    "  indented",
    "\ttabbed",
    "",
    "ValueError: bad",
    "Traceback (most recent call last):",
    '  File "/a.py", line 1, in f',
    "\tat a.b.C(D.java:1)",
    "at x",
    "... 5 more",
    "Caused by: x",
    "goroutine 1 [running]:",
    "exit status 2",
    "main.run(0x1)",
    ".x(",
    "a. b (",
    "from z",
    "plain\n\n",
    "plain é",
    "    at Object (a.js:1:2)",
]


def continues(prev, line):
    """The universal rule, written for plain strings."""
    indented = line[:1] in (" ", "\t")
    body = line.lstrip(" \t")
    dot = line.find(".")
    return (
        line == ""
        or indented
        or (": " in line and prev[:1] in (" ", "\t") and prev != "")
        or body.startswith(("at ", "... ", "Caused by:", "Suppressed:", "from "))
        or line.startswith(("goroutine ", "exit status "))
        or (dot > 0 and "(" in line[dot:])
    )


def fold(rows, idle_ms=None):
    out = {}
    for key in sorted({r[0] for r in rows}):
        groups, prev = [], None
        for _, seq, ts, line, tags in sorted(r for r in rows if r[0] == key):
            line = line.rstrip("\n")
            idle = (
                idle_ms is not None
                and prev is not None
                and (ts - prev[1]) >= dt.timedelta(milliseconds=idle_ms)
            )
            if prev is not None and continues(prev[0], line) and not idle:
                groups[-1][3].append(line)
            else:
                groups.append((seq, ts, tags, [line]))
            prev = (line, ts)
        out[key] = [(s, t, g, "\n".join(ls), len(ls)) for s, t, g, ls in groups]
    return out


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stream_key, []).append((r.seq, r.ts, r.tags, r.line, r.n_lines))
    return {k: sorted(v, key=lambda g: g[0]) for k, v in out.items()}


def make(seed, n=400):
    rng = random.Random(seed)
    rows, ts = [], T0
    for seq in range(n):
        ts += dt.timedelta(milliseconds=rng.choice([0, 1, 100, 499, 500, 501]))
        key = rng.choice(["hot", "hot", "hot", "a", "b"])
        # Long runs of continuations cross several small buckets.
        word = rng.choice(VOCABULARY) if rng.random() < 0.5 else "  run"
        rows.append((key, seq * rng.randint(1, 1) + (1000 if seq > n // 2 else 0), ts, word, f"t{seq}"))
    return rows


@pytest.mark.parametrize("bucket_rows", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("idle_ms", [None, 500])
def test_matches_fold(spark, bucket_rows, idle_ms):
    rows = make(bucket_rows)
    df = spark.createDataFrame(
        rows, "stream_key string, seq bigint, ts timestamp, line string, tags string"
    ).repartition(5)
    got = grouped(recombine(df, idle_ms=idle_ms, bucket_rows=bucket_rows))
    assert got == fold(rows, idle_ms)


@pytest.mark.parametrize("group_buckets", [1, 2, 5])
@pytest.mark.parametrize("idle_ms", [None, 500])
def test_borders_in_groups(spark, group_buckets, idle_ms):
    rows = make(group_buckets + 100)
    df = spark.createDataFrame(
        rows, "stream_key string, seq bigint, ts timestamp, line string, tags string"
    ).repartition(5)
    got = grouped(recombine(df, idle_ms=idle_ms, bucket_rows=3, group_buckets=group_buckets))
    assert got == fold(rows, idle_ms)


def test_texts_are_in_no_window_over_buckets(spark):
    """Such a window sees flags; the lines are shuffled once, for both of their uses."""
    rows = make(1)
    df = spark.createDataFrame(
        rows, "stream_key string, seq bigint, ts timestamp, line string, tags string"
    ).repartition(5)
    records = recombine(df, bucket_rows=7, group_buckets=2)
    records.collect()
    plan = records._jdf.queryExecution().optimizedPlan()
    windows, left = [], [plan]
    while left:
        node = left.pop()
        if node.nodeName() == "Window":
            windows.append(node)
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    over_buckets = [w for w in windows if "_bucket" not in w.partitionSpec().toString()]
    assert over_buckets
    for window in over_buckets:
        fields = window.child().output().toString()
        assert not re.search(r"\b(_text|_head|line)#", fields)
    final = records._jdf.queryExecution().executedPlan().toString()
    assert final.split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def test_one_group_over_all_buckets(spark):
    rows = [("k", i, T0, "start" if i == 0 else " x", "t") for i in range(50)]
    df = spark.createDataFrame(
        rows, "stream_key string, seq bigint, ts timestamp, line string, tags string"
    )
    assert grouped(recombine(df, bucket_rows=3)) == fold(rows)


def test_null_line_and_key(spark):
    df = spark.createDataFrame(
        [(None, 0, T0, None), (None, 1, T0, "x")],
        "stream_key string, seq bigint, ts timestamp, line string",
    )
    rows = recombine(df).orderBy("seq").collect()
    assert [(r.stream_key, r.line) for r in rows] == [("", ""), ("", "x")]


def test_python_sequence(spark):
    lines = [
        "Traceback (most recent call last):",
        '  File "/app/x.py", line 42, in foo',
        '    raise RuntimeError("boom")',
        "RuntimeError: boom",
        "INFO next request started",
    ]
    df = spark.createDataFrame(
        [("k", i, T0, s) for i, s in enumerate(lines)],
        "stream_key string, seq bigint, ts timestamp, line string",
    )
    rows = recombine(df, rule="python").orderBy("seq").collect()
    assert [r.line for r in rows] == ["\n".join(lines[:4]), lines[4]]


@pytest.mark.parametrize(
    "rule, prev, line, want",
    [
        ("java", "", "\tat com.Foo.bar(Foo.java:1)", True),
        ("java", "", "  at com.Foo.bar(Foo.java:1)", True),
        ("java", "", "\t... 5 more", True),
        ("java", "", "Caused by: java.io.IOException", True),
        ("java", "", "INFO regular line", False),
        ("python", "x", "", False),
        ("python", "x", "A: b", False),
        ("python", " x", "A: b", True),
        ("go", "", "", True),
        ("go", "", "main.f(1)", True),
        ("go", "", ".f(1)", False),
        ("go", "", "exit status 2", True),
        ("node", "", "    at x", True),
        ("node", "", "  at x", False),
        ("ruby", "", "\tfrom x", True),
        ("ruby", "", "fromage", False),
        ("universal", "", "", True),
        ("universal", "", "INFO a.b(c", True),
        ("universal", "", "INFO", False),
    ],
)
def test_rules(spark, rule, prev, line, want):
    df = spark.createDataFrame([(prev, line)], "p string, l string")
    assert df.select(RULES[rule](F.col("p"), F.col("l")).alias("c")).first().c is want


def test_stream_key(spark):
    cases = [
        ({"k8s_pod": "p", "container_name": "c", "file_path": "f"}, "k8s:p/c"),
        ({"k8s_pod": "p"}, "k8s:p/"),
        ({"k8s_pod": "", "container_name": "c"}, "docker:c"),
        ({"systemd_unit": "u", "file_path": "f"}, "journald:u"),
        ({"systemd_unit": "", "file_path": "f"}, "file:f"),
        ({}, "src"),
        (None, "src"),
    ]
    df = spark.createDataFrame(
        [("src", t, w) for t, w in cases], "source string, tags map<string,string>, want string"
    )
    for r in df.select(stream_key(F.col("source"), F.col("tags")).alias("got"), "want").collect():
        assert r.got == r.want


def test_rules_share_one_shuffle_of_the_lines(spark, tmp_path):
    """How often lines are dealt out does not grow with the rules that look at them."""
    path = str(tmp_path / "lines")
    spark.range(2000).selectExpr(
        "concat('k', id % 3) stream_key", "id seq", "timestamp_seconds(id) ts", "concat('  line ', id) line"
    ).write.parquet(path)

    def dealt(*rules):
        parts = [recombine(spark.read.parquet(path), rule).groupBy("stream_key").count() for rule in rules]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        whole.collect()
        plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = [line for line in plan.split("\n") if "_bucket" in line and "REPARTITION_BY_COL" in line]
        return sum("ReusedExchange" not in line for line in lines)

    assert 0 < dealt("java", "node") == dealt("java", "node", "ruby", "python")
