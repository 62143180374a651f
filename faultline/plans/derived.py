"""Log data derived from the given tables, by SQL that Spark and DuckDB both run.

The tables hold no logs, so each text below makes some out of whole tables.  A name
like ``@events`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from faultline.session import configure

TABLE = re.compile(r"@(events|documents|part)\b")


def duckdb_text(sql: str) -> str:
    return TABLE.sub(r"\1", sql)


IDS = {"events": "event_id", "documents": "doc_id", "part": "p_partkey"}


def spread(df: DataFrame, name: str) -> DataFrame:
    """A table dealt out by its id, for work that is heavy per row however the files are cut.

    A number that is asked for is kept: small tables are not put back into one partition.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, IDS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, heavy: bool = False) -> DataFrame:
    """Run a derivation on the tables of ``sf_dir``; ``heavy`` work is spread first."""
    for name in set(TABLE.findall(sql)):
        source = table(spark, sf_dir, name)
        (spread(source, name) if heavy else source).createOrReplaceTempView(f"faultline_{name}")
    return spark.sql(TABLE.sub(r"faultline_\1", sql))


def _values(rows: list[tuple]) -> str:
    def literal(value: object) -> str:
        if value is None:
            return "CAST(NULL AS STRING)"
        return str(value) if isinstance(value, int) else "'" + str(value) + "'"

    return ",\n".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


# Template, line number, text before and after the event id; "~" is an apostrophe.
LOG_TEMPLATES = [
    (0, 0, '{"level":"error","message":"order ', '","logger":"django.request","error":"E"}'),
    (1, 0, "Traceback (most recent call last):", None),
    (1, 1, '  File "/app/v.py", line 7, in f', None),
    (1, 2, '    raise ValueError("x")', None),
    (1, 3, "ValueError: bad id ", ""),
    (2, 0, "java.lang.IllegalStateException: id ", ""),
    (2, 1, "    at com.example.Foo.bar(Foo.java:42)", None),
    (2, 2, "Caused by: java.io.IOException: disk full", None),
    (3, 0, "panic: index ", ""),
    (3, 1, "", None),
    (3, 2, "goroutine 1 [running]:", None),
    (3, 3, "main.run(0x1)", None),
    (3, 4, "    /app/main.go:42 +0x1", None),
    (4, 0, "TypeError: cannot read ", ""),
    (4, 1, "    at Object.<anonymous> (/app/s.js:42:18)", None),
    (5, 0, "/app/foo.rb:42:in `bar~: no conn ", " (ConnError)"),
    (5, 1, "  from /app/m.rb:5:in `<main>~", None),
    (6, 0, "2024-01-01 ERROR user a@b.com from 10.0.0.1 failed ", ""),
    (7, 0, '{"level":"info","error":null,"id":', "}"),
    (8, 0, "INFO request ", " ok"),
]

# One log line per row, 20 streams.
LOG_LINES = f"""
SELECT concat('file:/logs/app', CAST(e.user_id % 20 AS STRING), '.log') AS stream_key,
  'file' AS source,
  concat('/logs/app', CAST(e.user_id % 20 AS STRING), '.log') AS file_path,
  e.event_id * 10 + t.line_no AS seq,
  CAST(e.ts AS TIMESTAMP) AS ts,
  replace(CASE WHEN t.post IS NULL THEN t.pre
    ELSE concat(t.pre, CAST(e.event_id AS STRING), t.post) END, '~', chr(39)) AS line
FROM @events e JOIN (VALUES {_values(LOG_TEMPLATES)}) AS t(tmpl, line_no, pre, post)
ON t.tmpl = CASE WHEN e.event_type = 'error' THEN e.event_id % 8 ELSE 8 END
"""

# Whole trace texts of many shapes; "#" is the event id, "~" ends a line, "^" is an
# apostrophe and "@t" a tab.
TRACE_SHAPES = [
    (0, 'noise~Traceback (most recent call last):~  File "/a.py", line 1, in f~    x = #~'
        '  File "/b.py", line 22, in <module>~  File "/c.py", line 0, in g~   three~pkg.mod.Err_#: bad: #~'
        '  File "/late.py", line 9, in h'),
    (1, 'Traceback (most recent call last):~  File "/a.py", line #, in f~    only frames'),
    (2, 'Traceback (most recent call last): # nothing here'),
    (3, 'x Traceback (most recent call last):~KeyError: ~  tail'),
    (4, 'start #~Exception in thread "main" java.lang.IllegalStateException~@tat a.b.C.d(C.java:#)~'
        '@tat app//e.F$G.h(Native Method)~@t... 3 more~Caused by: java.io.IOException: x~@tat k.L.m(L.java)~'
        '@tSuppressed: y~~  at n.O.p(O.java:7)~end~@tat q.R.s(R.java:1)'),
    (5, 'java.lang.Error: # alone~no frame'),
    (6, 'com.x.MyThrowable: v #~  at a.b(c.kt:3)~  not a frame'),
    (7, 'fatal error: all goroutines are asleep #~~goroutine 1 [running]:~main.main()~@t/app/main.go:18 +0x52~'
        'pkg/sub.Fn(0x1, 0x#)~no file~main.(*T).m(1)~x/y.z(2)~@t/app/y.go:# +0x1~exit status 2'),
    (8, 'log~panic: #'),
    (9, '  RangeError: too big #~    at Object.<anonymous> (/app/s.js:42:18)~    at async f g (a b.js:1:2)~'
        '    at /lib/foo.js:10:5~    at native~@tat z (q.js:#:2)~stop~    at y (q.js:1:2)'),
    (10, 'Error: just text #'),
    (11, 'CustomError: ~    at f (x.js:0:0)'),
    (12, 'pre #~/app/foo.rb:42:in `bar^: no conn # (Net::ReadTimeout)~  from /app/m.rb:5:in `init^~'
         '@tfrom /app/m.rb:#:in `<main>^~gap~  from /x.rb:1:in `no^'),
    (13, '/app/foo.rb:7:in `baz^:  (E)'),
    (14, '{"level":"error","message":"j #"}'),
    (15, 'plain # error~second line'),
    (16, 'quiet #'),
    (17, 'TypeError: both #~    at f (x.js:3:4)~Traceback (most recent call last):~ValueError: wins #'),
]
TRACES = f"""
SELECT 'traces' AS stream_key, e.event_id AS seq, 'traces' AS file_path, CAST(e.ts AS TIMESTAMP) AS ts,
  replace(replace(replace(replace(t.shape, '#', CAST(e.event_id AS STRING)), '~', chr(10)), '^', chr(39)),
    '@t', chr(9)) AS line
FROM @events e JOIN (VALUES {_values(TRACE_SHAPES)}) AS t(kind, shape)
ON t.kind = e.event_id % {len(TRACE_SHAPES)}
"""

# Lines with every kind of secret, and near misses; "#" is the event id.
SECRET_SHAPES = [
    (0, 'Authorization: bEARER abc.#-x_y~z+/= next Bearer  q# BearerX no'),
    (1, 'jwt eyJhbGci#.eyJzdWIi.c2ln-# and eyJa.eyJb no eyJx.eyJy.z'),
    (2, 'key sk_live_abcdefgh12345678# rk_test_0123456789abcde xsk_test_0123456789abcdef0 pk_test_0123456789ABCDEF'),
    (3, 'api_key="abcdefghij0123456789#" API-KEY: abcdefghij012345 apikey=short apiKey = ^abcdefghij0123456_-^'),
    (4, 'fe80:0:0:0:1:2:3:# ::1 12:30:00 dead:beef:cafe x1:2:3 1:2:3:4:5:6:7:8:9:a'),
    (5, 'é10.0.0.1 10.0.0.2é 1.2.3.4.5 _10.0.0.1 1234.1.1.1 999.999.999.# v1.2.3'),
    (6, 'mail a.b+c%d@ex-ample.co.uk_x@y.zz,bob@host @no.com a@b c@d.e #@x.org.'),
    (7, 'Bearer eyJhbGci#.eyJzdWIi.c2ln token api_key: eyJhbGci#.eyJzdWIi.c2ln'),
    (8, 'nothing to hide #'),
]
SECRETS = f"""
SELECT e.event_id, replace(replace(t.shape, '#', CAST(e.event_id AS STRING)), '^', chr(39)) AS line
FROM @events e JOIN (VALUES {_values(SECRET_SHAPES)}) AS t(kind, shape)
ON t.kind = e.event_id % {len(SECRET_SHAPES)}
"""

# Containers starting and dying; one per user.
CONTAINER_EVENTS = """
SELECT concat('c', CAST(user_id AS STRING)) AS container_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'start' WHEN 'error' THEN 'die'
    ELSE event_type END AS status,
  concat('/box', CAST(user_id AS STRING)) AS name
FROM @events
"""

# JSON records of many shapes; "#" is the event id.
JSON_SHAPES = [
    (0, '{"level":"error","message":"m#","exception":{"type":"T","value":"v#","stacktrace":'
        '{"frames":[{"filename":"a.py","function":"f","lineno":#},7,{"file":"b.py","method":"g",'
        '"code":"x = 1","lineno":"9"},{"lineno":3.75}]}},"timestamp":"2026-01-15T10:30:45Z",'
        '"environment":"prod","release":"v1.2.3"}'),
    (1, '{"severity":"CRIT","msg":"m#","error":"ENOENT","logger":"express.router"}'),
    (2, '{"level":"warn","message":"m#"}'),
    (3, '{"level":50,"severity":"error","log":"m#","version":"v#"}'),
    (4, '{"level":"error","message":"m#"} trailing'),
    (5, '{"level":"error","message":"","msg":"second #","hostname":"h#","env":"dev","app_version":"2"}'),
    (6, '  {"level":" Fatal ","message":"spaced #"}  '),
    (7, '{ not valid #'),
    (8, '["level","error",#]'),
    (9, '{"level":"err","err":"flat #","language":"rust","ts":"2026-01-15"}'),
    (10, '{"level":"error","logger_name":"app.django.views","exception":{"class":"K","message":"M#"},'
         '"time":"2026-01-15T10:30:45.25+02:00","host":"h"}'),
    (11, '{"level":"info","error":"x","message":"m#"}'),
    (12, '{"level":"Notice","message":"m#"}'),
    (13, '{"level":"error","message":7,"exception":{"value":"only #","stacktrace":{"frames":{}}},'
         '"logger":"node-app","server_name":"s"}'),
    (14, '{"level":"error","exception":{"stacktrace":{"frames":[]}},"error":"late #","platform":"go"}'),
    (15, 'plain text # error'),
    (16, '{"level":"TRACE #","message":"m"}'),
]
JSON_LINES = f"""
SELECT e.event_id, replace(t.shape, '#', CAST(e.event_id AS STRING)) AS line
FROM @events e JOIN (VALUES {_values(JSON_SHAPES)}) AS t(kind, shape)
ON t.kind = e.event_id % {len(JSON_SHAPES)}
"""

# Pod log lines: system and user namespaces, generated and plain pod names.
POD_LINES = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, dirname,
  concat('/var/log/pods/', dirname, '/app/0.log') AS file_path,
  concat('ERROR ', event_type) AS line
FROM (SELECT *, CASE
    WHEN event_id % 11 = 0 THEN concat('malformed_', CAST(event_id AS STRING))
    WHEN event_id % 11 = 1 THEN concat('ns_some_pod_', CAST(event_id AS STRING))
    ELSE concat(
      CASE user_id % 5 WHEN 0 THEN 'kube-system' WHEN 1 THEN 'kube-public'
        WHEN 2 THEN 'staging' ELSE 'default' END, '_',
      CASE WHEN event_id % 3 = 0 THEN concat('redis-', CAST(event_id AS STRING))
        WHEN event_id % 3 = 1 THEN concat('svc-', event_type, '-7d9f4b8c-xq2k4')
        ELSE concat('job-', event_type, '-UP9f-abcde') END, '_uid-', CAST(event_id AS STRING))
    END AS dirname FROM @events) AS p
"""

# Journal entries: user and system units, text and byte messages, broken lines.
JOURNAL_LINES = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, CASE
    WHEN event_id % 13 = 0 THEN concat('{broken ', CAST(event_id AS STRING))
    WHEN event_id % 13 = 1 THEN concat('[', CAST(event_id AS STRING), ']')
    ELSE concat('{"', CASE WHEN event_id % 4 = 0 THEN 'UNIT' ELSE '_SYSTEMD_UNIT' END, '":"',
      CASE event_type WHEN 'error' THEN 'nginx.service' WHEN 'click' THEN 'systemd-logind.service'
        WHEN 'view' THEN 'dbus.service' WHEN 'signup' THEN 'app.service' ELSE 'polkit.service.x' END,
      '","MESSAGE":', CASE WHEN event_id % 7 = 0 THEN '[1,2]' WHEN event_id % 7 = 1 THEN '""'
        ELSE concat('"msg ', CAST(event_id AS STRING), '"') END,
      CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"_HOSTNAME":"h', CAST(user_id AS STRING), '"') END,
      ',"PRIORITY":', CASE WHEN event_id % 2 = 0 THEN '"3"' ELSE '3' END,
      ',"__REALTIME_TIMESTAMP":"', CASE WHEN event_id % 6 = 0 THEN 'soon'
        ELSE concat('17141280', CAST(10000000 + event_id AS STRING)) END, '"}')
    END AS line FROM @events
"""

# OTLP requests with two resources each, and some that cannot be decoded.
OTLP_REQUESTS = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, CASE
    WHEN event_id % 17 = 0 THEN concat('{"resourceLogs": broken ', CAST(event_id AS STRING))
    WHEN event_id % 17 = 1 THEN '{"resourceLogs":[]}'
    ELSE concat('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"old"}},',
      '{"key":"service.name","value":{"stringValue":"svc', CAST(user_id AS STRING), '"}},',
      '{"key":"host.name","value":{"intValue":"', CAST(user_id AS STRING), '"}},',
      '{"key":"other","value":{"stringValue":"x"}}]},',
      '"scopeLogs":[{"scope":{"name":"scope-', event_type, '"},"logRecords":[',
      '{"timeUnixNano":"17141280000', CAST(10000000 + event_id AS STRING), '","severityNumber":',
      CAST(event_id % 25 AS STRING), ',"body":{"stringValue":"', event_type, ' ',
      CAST(event_id AS STRING), '"},"traceId":"t', CAST(event_id AS STRING), '"},',
      '{"timeUnixNano":"never","severityText":"Custom","severityNumber":9,"body":{"intValue":"',
      CAST(event_id AS STRING), '"},"spanId":"s"}]}]},',
      '{"scopeLogs":[{"logRecords":[{"body":{"boolValue":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,
      '}},{"body":{"arrayValue":{"values":[]}}}]}]}]}')
    END AS payload FROM @events
"""

# Document texts cut into pieces of 100 characters, one container per source.
CONTAINER_CHUNKS_SPARK = """
SELECT concat('c', source) AS container_id, source, doc_id * 100000 + pos AS chunk_no, col AS payload
FROM (SELECT doc_id, source, posexplode(regexp_extract_all(text, '(?s).{1,100}', 0)) FROM @documents) AS d
"""
CONTAINER_CHUNKS_DUCKDB = """
SELECT concat('c', source) AS container_id, source, doc_id * 100000 + pos AS chunk_no, p[pos + 1] AS payload
FROM (SELECT doc_id, source, p, unnest(range(len(p))) AS pos
  FROM (SELECT doc_id, source, regexp_extract_all(text, '(?s).{1,100}') AS p FROM @documents)) AS d
"""

# Long texts, most of them with an error word at the start or the end.
NOTES = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('  Error: ', text)
  WHEN 2 THEN concat(text, ' traceback') ELSE concat('é panic ', text, chr(10)) END AS text
FROM @documents
"""

# Lines for a layer of one's own, among errors and plain ones.
OOPS = """
SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN concat('OOPS part ', CAST(event_id AS STRING), ' gone')
  WHEN 1 THEN concat('ERROR part ', CAST(event_id AS STRING)) ELSE 'all is fine' END AS line
FROM @events
"""

# Limiter arrivals: one hot key, and time pressed so that the keys run dry.
ARRIVALS = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS source,
  event_id AS seq, event_id, event_type, {micros} AS micros
FROM @events
"""
ARRIVALS_SPARK = ARRIVALS.format(micros="unix_micros(CAST(ts AS TIMESTAMP)) div 2000")
ARRIVALS_DUCKDB = ARRIVALS.format(micros="epoch_us(ts) // 2000")

# The same arrivals, seen in batches of a minute: 250 events, each come since the batch before.
BATCH_MICROS = 60_000_000
BATCHED_ARRIVALS = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS source, event_id AS seq,
  CAST(floor(event_id / 250) AS BIGINT) + CASE WHEN event_id >= 2000 THEN 7 ELSE 0 END AS batch
FROM @events
"""

# Retry queue: one per document source, with failing and unreadable entries.
QUEUE = """
SELECT source AS queue, doc_id AS seq, octet_length({text}) AS bytes,
  doc_id % 37 = 36 AS failed, doc_id % 10 = 3 AS corrupt
FROM @documents
"""
QUEUE_SPARK = QUEUE.format(text="text")
QUEUE_DUCKDB = QUEUE.format(text="encode(text)")

# Names in the queue folders, numbered entries and others.
QUEUE_NAMES = """
SELECT source AS queue, CASE doc_id % 6
    WHEN 1 THEN concat('tmp-', CAST(doc_id AS STRING), '.json')
    WHEN 2 THEN concat(lpad(CAST(doc_id AS STRING), 20, '0'), '.json.tmp')
    WHEN 3 THEN concat(lpad(CAST(doc_id AS STRING), 19, '0'), '.json')
    ELSE concat(lpad(CAST(doc_id AS STRING), 20, '0'), '.json') END AS name
FROM @documents
"""
QUEUE_ARRIVALS = """
SELECT concat('src', CAST(user_id % 25 AS STRING)) AS queue, event_id AS seq FROM @events
"""

# Delivery attempts: a user's events are the attempts on one delivery.
ATTEMPTS = """
SELECT delivery AS event_id, attempt, CASE (attempt * 7 + delivery) % 11
    WHEN 0 THEN 201 WHEN 1 THEN 404 WHEN 2 THEN CAST(NULL AS INT) WHEN 3 THEN 302 ELSE 503 END AS status
FROM (SELECT user_id * 100000 + (event_id % 97) AS delivery,
    row_number() OVER (PARTITION BY user_id * 100000 + (event_id % 97) ORDER BY event_id) AS attempt
  FROM @events) AS a
"""

# Health reports of one source per event type.
REPORTS = """
SELECT event_type AS source, event_id % 50 AS emitted, event_id % 3 AS dropped,
  CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 = 1 THEN concat('err ', CAST(event_id AS STRING))
    ELSE CAST(NULL AS STRING) END AS last_error,
  CASE WHEN event_id % 9 < 2 THEN CAST(ts AS TIMESTAMP) ELSE CAST(NULL AS TIMESTAMP) END AS last_error_at
FROM @events
"""

# Python files, three repositories; "~" ends a line.
FILE_TEMPLATES = [
    (0, "import os~~def first_#(x):~    return x~~class A:~    def go(self, y):~        def inner(z):~"
        "            return z~        return inner~~    @classmethod~    def make(cls):~        pass~"
        "# tail~"),
    (1, "async def run_#(~    a,~    b,~):~    await a~~~def two_#():~\tpass~   ~x = 1~"),
    (2, "x = #~y = 2~"),
    (3, "class B:~  # note~  def f(self):~    if x:~      pass~# flush left~    return 1~  def g(selfish):~"
        "    pass~  def h(cls ): return 2~def last_#(cls~  ):~  return 3"),
]
SOURCE_FILES = f"""
SELECT concat('repo', CAST(CASE WHEN p.p_partkey % 3 = 0 THEN 0 ELSE p.p_partkey % 4 END AS STRING)) AS repo,
  concat('src/m', CAST(p.p_partkey % 10 AS STRING),
    CASE WHEN p.p_partkey % 7 = 0 THEN '-x' ELSE '' END, '/f', CAST(p.p_partkey AS STRING), '.py') AS path,
  replace(replace(t.body, '#', CAST(p.p_partkey AS STRING)), '~', chr(10)) AS content
FROM @part p JOIN (VALUES {_values(FILE_TEMPLATES)}) AS t(kind, body) ON t.kind = p.p_partkey % 4
"""

# Paths of a source tree, wanted and not.
TREE_PATHS = """
SELECT concat(CASE p_partkey % 9 WHEN 0 THEN 'build/' WHEN 1 THEN 'src/node_modules/'
    WHEN 2 THEN 'a/.venv/b/' WHEN 3 THEN 'distant/' WHEN 4 THEN '' ELSE 'pkg/sub/' END,
  CASE p_partkey % 5 WHEN 0 THEN '__init__' WHEN 1 THEN 'build' ELSE 'mod' END, CAST(p_partkey AS STRING),
  CASE p_partkey % 4 WHEN 0 THEN '.pyc' WHEN 1 THEN '' WHEN 2 THEN '.tar.py' ELSE '.py' END) AS path
FROM @part
"""

# Frames that name places in the files above; one place holds a third of them.
FRAMES = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'src/m4/f4.py'
    ELSE concat('src/m', CAST((event_id % 150) % 10 AS STRING),
      CASE WHEN (event_id % 150) % 7 = 0 THEN '-x' ELSE '' END, '/f', CAST(event_id % 150 AS STRING), '.py')
    END AS filename,
  CASE WHEN event_id % 3 = 0 THEN 8 WHEN event_id % 19 = 0 THEN CAST(NULL AS BIGINT)
    ELSE event_id % 20 END AS lineno
FROM @events
"""

# Tag sets of every kind of stream.
TAGGED = """
SELECT event_id, event_type AS source,
  CASE WHEN event_id % 5 = 0 THEN concat('pod', CAST(user_id AS STRING)) WHEN event_id % 5 = 1 THEN '' END AS pod,
  CASE WHEN event_id % 3 = 0 THEN concat('box', CAST(user_id AS STRING)) WHEN event_id % 3 = 1 THEN '' END AS box,
  CASE WHEN event_id % 4 = 0 THEN concat('unit', CAST(user_id AS STRING)) WHEN event_id % 4 = 1 THEN '' END AS unit,
  CASE WHEN event_id % 7 < 3 THEN concat('/f', CAST(user_id AS STRING)) END AS file_path
FROM @events
"""
