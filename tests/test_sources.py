"""Readers and decoders on small files and tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from faultline.functions.variants import parse_object
from faultline.operators.recombine import recombine, with_stream_key
from faultline.operators.redact import redact, usable_patterns
from faultline.sources.containers import (
    assemble_lines,
    container_name,
    container_source,
    started_containers,
)
from faultline.sources.journal import decode_journal, journal_source, rejected_entries
from faultline.sources.otlp import (
    DOUBTFUL,
    _all_types_fit,
    fits_request,
    flatten_requests,
    general_number,
    otlp_source,
    rejected_requests,
    severity,
    severity_band,
)
from faultline.sources.pods import pod_meta, pod_source
from faultline.sources.text import file_source
from faultline.sources.trees import tree_source
from faultline.sources.union import union_sources

T0 = dt.datetime(2026, 1, 1)


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [
        ("user alice@example.com tried to log in", "user [email] tried to log in"),
        ("from 192.168.1.42 connection refused", "from [ip] connection refused"),
        ("é10.0.0.1 10.0.0.2é", "é[ip] [ip]é"),
        ("2026-04-26 12:30:00 x", "2026-04-26 [ip] x"),
        ("_10.0.0.1", "_10.0.0.1"),
        ("1.2.3.4.5", "[ip].5"),
        ("Authorization: bEaReR abc.def", "Authorization: Bearer [token]"),
        ("jwt eyJa.eyJb.c-d", "jwt [jwt]"),
        ("sk_test_" + "a" * 16 + " sk_test_" + "a" * 15, "[api_key] sk_test_" + "a" * 15),
        ('API-key = "' + "k" * 20 + '"', 'API-key = "[api_key]"'),
        ("fe80:0:0:0:1:2:3:4", "[ip]"),
        ("a@b.com_c@d.org.x@y.io", "[email][email][email]"),
        ("a@b c@d.e@f.gh x@@y.zz", "a@b c@[email] x@@y.zz"),
        ("x" * 300_000 + " a@b.com", "x" * 300_000 + " [email]"),
        ("API\u212aEY=" + "k" * 16, "API\u212aEY=[api_key]"),
    ],
)
def test_redact(spark, text, want):
    assert one(spark, redact, text) == want


def test_redact_selected_and_custom(spark):
    text = "a@b.com 10.0.0.1 ssn=123-45-6789"
    assert one(spark, lambda c: redact(c, ["email", "nope"]), text) == (
        "[email] 10.0.0.1 ssn=123-45-6789"
    )
    good = usable_patterns(spark, [r"ssn=\d{3}-\d{2}-\d{4}", "("])
    assert len(good) == 1
    assert one(spark, lambda c: redact(c, custom=good), text) == "[email] [ip] [redacted]"


def test_strict_json(spark):
    cases = {
        '{"a":1}': True,
        '{"a":1} x': False,
        "{'a':1}": False,
        '{"a":1},{"b":2}': False,
        '{"a":1}]': False,
        '{"a":1}],[1': False,
        '{"a":1}] }': False,
        '{"a":1},1]': False,
        '{"a":1},': False,
        ' \t{"a":1}\r\n': True,
        "null": False,
        '{"a":1,"a":2}': True,
        "[1]": False,
        "1": False,
        "{}": True,
        '{"a":NaN}': False,
        "": False,
    }
    for text, want in cases.items():
        assert one(spark, lambda c: parse_object(c).isNotNull(), text) is want, text


def test_file_source_order_over_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 1200)):
        (tmp_path / name).write_bytes(b"".join(b"%s line %d\r\n" % (name.encode(), i) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    try:
        rows = file_source(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.seq for r in rows}) == len(rows) == 6200
    for name, n in (("a.log", 5000), ("b.log", 1200)):
        mine = sorted((r for r in rows if r.tags["file_path"].endswith(name)), key=lambda r: r.seq)
        assert [r.line for r in mine] == [f"{name} line {i}\r" for i in range(n)]
        assert mine[0].tags["file_path"] == str(tmp_path / name)
    assert {r.source for r in rows} == {"file"}


@pytest.mark.parametrize(
    "name, want",
    [
        (
            "default_checkout-svc-7d9f4b8c-xq2k4_abcd-1234",
            ("default", "checkout-svc-7d9f4b8c-xq2k4", "abcd-1234", "checkout-svc"),
        ),
        ("my-ns_some_pod_name_uid123", ("my-ns", "some_pod_name", "uid123", "some_pod_name")),
        ("db_redis-0_uid456", ("db", "redis-0", "uid456", "redis-0")),
        ("malformed", None),
        ("a_b", None),
        ("a__c", ("a", "", "c", "")),
        ("n_x-abcd-ABCD_u", ("n", "x-abcd-ABCD", "u", "x-abcd-ABCD")),
        ("n_a-bcde-fghi-jklm_u", ("n", "a-bcde-fghi-jklm", "u", "a-bcde")),
    ],
)
def test_pod_meta(spark, name, want):
    got = one(spark, pod_meta, name)
    assert (got if got is None else tuple(got)) == want


def test_pod_source(spark, tmp_path):
    for ns in ("default", "kube-system", "mine"):
        folder = tmp_path / f"{ns}_web-7d9f4b8c-xq2k4_u1" / "app"
        folder.mkdir(parents=True)
        (folder / "0.log").write_text("2026-01-01T00:00:00.1Z stderr F ERROR x\n")
        (folder / "0.log.old").write_text("ERROR old\n")
    (tmp_path / "odd" / "app").mkdir(parents=True)
    (tmp_path / "odd" / "app" / "0.log").write_text("ERROR y\n")
    rows = pod_source(spark, str(tmp_path), ["mine"]).collect()
    assert [r.line for r in rows] == ["2026-01-01T00:00:00.1Z stderr F ERROR x"]
    assert rows[0].tags == {
        "k8s_namespace": "default",
        "k8s_pod": "web-7d9f4b8c-xq2k4",
        "k8s_pod_uid": "u1",
        "k8s_deployment": "web",
        "container_name": "app",
    }
    rows = pod_source(spark, str(tmp_path), strip_runtime_prefix=True).collect()
    assert [r.line for r in rows] == ["ERROR x", "ERROR x"]


def test_journal(spark, tmp_path):
    entries = [
        {"_SYSTEMD_UNIT": "nginx.service", "MESSAGE": "up", "_HOSTNAME": "h", "PRIORITY": "3",
         "__REALTIME_TIMESTAMP": "1714128000000000"},
        {"_SYSTEMD_UNIT": "systemd-logind.service", "MESSAGE": "x"},
        {"UNIT": "a.service", "MESSAGE": [1, 2]},
        {"UNIT": "a.service", "MESSAGE": "m", "__REALTIME_TIMESTAMP": "not-a-number"},
        {"_SYSTEMD_UNIT": "", "UNIT": "ignored", "MESSAGE": "empty unit"},
        {"UNIT": "a.service", "MESSAGE": ""},
    ]
    lines = [json.dumps(e) for e in entries] + ["{broken"]
    df = spark.createDataFrame(
        [(i, T0, s) for i, s in enumerate(lines)], "seq bigint, ts timestamp, line string"
    )
    got = {r.seq: r for r in decode_journal(df).collect()}
    assert set(got) == {0, 3, 4}
    assert got[0].tags == {"systemd_unit": "nginx.service", "hostname": "h", "priority": "3"}
    assert got[0].ts.timestamp() == 1714128000
    assert got[3].ts == T0
    assert got[4].tags["systemd_unit"] == ""
    assert [r.seq for r in decode_journal(df, ["nginx.service"]).collect()] == [0]
    path = tmp_path / "j.json"
    path.write_text("\n".join(lines) + "\n")
    assert journal_source(spark, str(path)).count() == 3


def attr(key, **value):
    return {"key": key, "value": value}


def test_otlp(spark, tmp_path):
    request = {
        "resourceLogs": [
            {
                "resource": {"attributes": [
                    attr("service.name", stringValue="a"),
                    attr("service.name", stringValue="b"),
                    attr("host.name", intValue="7"),
                    attr("other", stringValue="z"),
                ]},
                "scopeLogs": [
                    {"scope": {"name": "sc"}, "logRecords": [
                        {"timeUnixNano": "1714128000000001999", "severityNumber": 17,
                         "body": {"stringValue": "boom"}, "traceId": "t", "spanId": "s"},
                        {"severityText": "Custom", "severityNumber": 3, "body": {"intValue": "5"},
                         "attributes": [attr("x", stringValue="y")]},
                    ]},
                    {"logRecords": [{"body": {"doubleValue": 0.5}, "timeUnixNano": "12x"}]},
                ],
            },
            {"scopeLogs": [{"logRecords": [{"body": {"boolValue": True}}, {"body": {"arrayValue": {}}}]}]},
            {"resource": {}},
        ]
    }
    payloads = [json.dumps(request), '{"resourceLogs":[]}', "{}", "null", "{broken", "[1]", '{"a":1} x',
                '{"a":1}]', "{'resourceLogs':[]}", ""]
    df = spark.createDataFrame(
        [(i, T0, p) for i, p in enumerate(payloads)], "seq bigint, ts timestamp, payload string"
    )
    rows = flatten_requests(df).orderBy("seq", "place").collect()
    assert [(r.seq, r.place, r.line) for r in rows] == [
        (0, 0, "boom"), (0, 1, "5"), (0, 2, "0.5"), (0, 3, "true"), (0, 4, ""),
    ]
    assert rows[0].tags == {
        "otel_severity": "ERROR", "otel_scope": "sc", "trace_id": "t", "span_id": "s",
        "service_name": "b", "hostname": "7",
    }
    assert rows[1].tags["otel_severity"] == "Custom"
    assert rows[2].tags == {"otel_severity": "", "service_name": "b", "hostname": "7"}
    assert rows[3].tags == {"otel_severity": ""}
    assert rows[2].ts == T0
    assert spark.createDataFrame([rows[0]]).select(F.unix_micros("ts").alias("u")).first().u == (
        1714128000000001
    )
    assert sorted(r.seq for r in rejected_requests(df).collect()) == [4, 5, 6, 7, 8, 9]
    path = tmp_path / "o.json"
    path.write_text(payloads[0] + "\n" + payloads[0] + "\n")
    read = otlp_source(spark, str(path)).collect()
    assert len({r.seq for r in read}) == 10


def test_severity(spark):
    bands = {0: "TRACE", 1: "TRACE", 4: "TRACE", 5: "DEBUG", 8: "DEBUG", 9: "INFO", 12: "INFO",
             13: "WARN", 16: "WARN", 17: "ERROR", 20: "ERROR", 21: "FATAL", 24: "FATAL"}
    for n, name in bands.items():
        assert one(spark, severity_band, n, "x int") == name
        assert one(spark, lambda c: severity(F.lit(""), c), n, "x int") == (name if n else "")


@pytest.mark.parametrize(
    "value, want",
    [
        (0.5, "0.5"), (1.0, "1"), (0.0, "0"), (-0.0, "-0"), (100000.0, "100000"),
        (1000000.0, "1e+06"), (123456789.0, "1.23456789e+08"), (0.0001, "0.0001"),
        (0.00001, "1e-05"), (-2.5e-7, "-2.5e-07"), (1e100, "1e+100"), (12.25, "12.25"),
        (-30.0, "-30"), (1.5e300, "1.5e+300"), (99999.5, "99999.5"),
    ],
)
def test_general_number(spark, value, want):
    assert one(spark, general_number, value, "x double") == want


@pytest.mark.parametrize("bucket_rows", [1, 2, 1 << 20])
def test_assemble_lines(spark, bucket_rows):
    streams = {
        "a": ["ab", "c\nde\nf", "g\n", "tail"],
        "b": ["first line\nsecond line\n", "err line\n"],
        "c": ["", "\n\n", "x", "", "y", "\n", "\nz\n\n"],
        "d": ["none"],
    }
    rows = [(c, i, p) for c, ps in streams.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "container_id string, chunk_no bigint, payload string")
    got = {}
    for r in assemble_lines(df.repartition(3), bucket_rows=bucket_rows).collect():
        got.setdefault(r.container_id, []).append((r.line_no, r.line))
    want = {c: list(enumerate("".join(ps).split("\n")[:-1])) for c, ps in streams.items()}
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}


def test_containers(spark):
    df = spark.createDataFrame(
        [("1", ["/web", "/x"], 0, "a\nb"), ("1", ["/web", "/x"], 1, "c\n"), ("2", [], 0, "z\n"),
         ("3", ["/skip"], 0, "q\n")],
        "container_id string, names array<string>, chunk_no bigint, payload string",
    )
    rows = container_source(df, ["skip"]).collect()
    assert sorted((r.tags["container_name"], r.seq, r.line) for r in rows) == [
        ("unknown", 0, "z"), ("web", 0, "a"), ("web", 1, "bc"),
    ]
    assert one(spark, container_name, ["//a"], "x array<string>") == "/a"
    events = spark.createDataFrame(
        [("1", 0, "start", "a"), ("1", 1, "start", "a"), ("2", 0, "start", "b"), ("2", 1, "die", "b")],
        "container_id string, seq bigint, status string, name string",
    )
    assert [tuple(r) for r in started_containers(events).collect()] == [("1", "a")]


def test_tree_source(spark, tmp_path):
    files = {
        "a.py": "x = 1\n", "pkg/__init__.py": "def f():\n  pass\n", "pkg/.hidden.py": "h\n",
        "pkg/b.txt": "no", "build/c.py": "no", "pkg/node_modules/d.py": "no", "pkg/dist.py": "yes\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {r.path: r.content for r in tree_source(spark, str(tmp_path), "r").collect()}
    assert set(got) == {"a.py", "pkg/__init__.py", "pkg/.hidden.py", "pkg/dist.py"}
    assert got["pkg/__init__.py"] == files["pkg/__init__.py"]
    assert {r.path for r in tree_source(spark, str(tmp_path), "r", [".txt"]).collect()} == {"pkg/b.txt"}


def test_union(spark, tmp_path, caplog):
    (tmp_path / "a.log").write_text("ERROR x\n  more\n")
    (tmp_path / "j.json").write_text('{"UNIT":"u","MESSAGE":"m"}\n')
    raw = union_sources(
        spark,
        [
            {"type": "file", "paths": [str(tmp_path / "a.log")]},
            {"type": "journald", "paths": [str(tmp_path / "j.json")]},
            {"type": "file", "paths": ["/nowhere"], "enabled": False},
            {"type": "carrier-pigeon"},
        ],
    )
    records = recombine(with_stream_key(raw)).collect()
    assert sorted((r.stream_key, r.line) for r in records) == [
        (f"file:{tmp_path}/a.log", "ERROR x\n  more"), ("journald:u", "m"),
    ]
    assert "carrier-pigeon" in caplog.text
    with pytest.raises(ValueError):
        union_sources(spark, [{"type": "file", "enabled": False}])


def test_tree_does_not_follow_linked_folders(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "link").symlink_to(tmp_path / "pkg")
    (tmp_path / "pkg" / "up").symlink_to(tmp_path)
    assert [r.path for r in tree_source(spark, str(tmp_path), "r").collect()] == ["pkg/a.py"]


def test_otlp_refuses_wrong_types(spark):
    record = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[%s]}]}]}'
    good = [
        '{"resourceLogs":null}',
        '{"resourceLogs":[null]}',
        record % '{"severityNumber":9,"traceId":null,"body":{"intValue":5}}',
        record % '{"attributes":[{"key":"a","value":{"boolValue":true}}],"unknown":{"x":[1]}}',
        record % '{"body":{"doubleValue":1.5e3}},null',
    ]
    bad = [
        '{"resourceLogs":{}}',
        '{"resourceLogs":[1]}',
        '{"resourceLogs":[{"resource":[]}]}',
        '{"resourceLogs":[{"resource":{"attributes":[{"key":1}]}}]}',
        '{"resourceLogs":[{"scopeLogs":"x"}]}',
        '{"resourceLogs":[{"scopeLogs":[{"scope":{"name":{}}}]}]}',
        record % '{"severityNumber":"9"}',
        record % '{"severityNumber":9.5}',
        record % '{"traceId":7}',
        record % '{"timeUnixNano":1714128000000000000}',
        record % '{"body":"text"}',
        record % '{"body":{"boolValue":"true"}}',
        record % '{},{"attributes":{}}',
    ]
    df = spark.createDataFrame(list(enumerate(good + bad)), "seq bigint, payload string")
    refused = [r.seq for r in rejected_requests(df).collect()]
    assert sorted(refused) == list(range(len(good), len(good) + len(bad)))


def test_otlp_doubtful_payloads_are_all_that_may_be_wrong(spark):
    """Values of every kind at every place: the pattern misses none that the full check refuses."""
    values = [
        "null", "true", "5", "-3", "9.5", "1e3", "12345678901234567890", '"t"', '"5"', '""', "{}", "[]",
        "[1]", '["x"]', "[{}]", "[null]", '[{},"x"]', "[{}, 2]", "[{},null,[]]", '[{} , "a\\"b"]', '{"a":1}',
        '[{},{"a":"b"}]',
    ]
    places = [
        '{"resourceLogs":@}',
        '{"resourceLogs" :  [{"resource" : @}]}',
        '{"resourceLogs":[{"resource":{"attributes":@}}]}',
        '{"resourceLogs":[{"resource":{"attributes":[{"key":@}]}}]}',
        '{"resourceLogs":[{"resource":{"attributes":[{"value":@,"key":"k"}]}}]}',
        '{"resourceLogs":[{"scopeLogs":@,"resource":{}}]}',
        '{"resourceLogs":[{"scopeLogs":[{"scope":@}]}]}',
        '{"resourceLogs":[{"scopeLogs":[{"scope":{"name":@,"version":"1"}}]}]}',
        '{"resourceLogs":[{"scopeLogs":[{"scope":{},"logRecords":@}]}]}',
    ]
    record = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{},{%s,"severityText":"x"}]}]}]}'
    names = ["timeUnixNano", "severityNumber", "severityText", "traceId", "body", "attributes", "unknown", "sp\\u0061nId"]
    places += [record % f'"{name}":@' for name in names]
    kinds = ["stringValue", "intValue", "doubleValue", "boolValue", "arrayValue"]
    places += [record % f'"body":{{"{kind}": @}}' for kind in kinds]
    payloads = [place.replace("@", value) for place in places for value in values]
    payloads += [None, "", "{", record % '"body":{"stringValue":"a \\"name\\": 5 }, 7"}']
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    told = df.select(
        "payload",
        fits_request(F.col("payload")).alias("got"),
        _all_types_fit(F.col("payload")).alias("want"),
        F.col("payload").rlike(DOUBTFUL).alias("doubtful"),
    ).collect()
    assert [r.payload for r in told if r.got != r.want] == []
    assert 100 < sum(not r.want for r in told) < len(told) - 100
    assert sum(not r.doubtful for r in told if r.doubtful is not None) > 50


def test_journal_entries_are_read_or_rejected(spark):
    good = ['{"MESSAGE":"m"}', ' {"MESSAGE":[1]} ', "{}", '{"a":{"b":"}"}}']
    bad = ["", "null", "[1]", '"{}"', "{} {}", '{"MESSAGE":"m"}x', '{"MESSAGE":"m"', "{}],[{}", None]
    rows = [(i, line, "x") for i, line in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "seq bigint, line string, _extra string")
    got = rejected_entries(df)
    assert got.columns == df.columns
    assert sorted(r.seq for r in got.collect()) == list(range(len(good), len(rows)))
    assert rejected_entries(df.limit(0)).collect() == []
