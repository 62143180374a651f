"""The same results in DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

from faultline.plans import derived as D
from faultline.plans import queries as Q
from faultline.plans.derived import duckdb_text

ORACLES: dict[str, str] = {}

NL = "chr(10)"
SPACES = r"[\t\n\v\f\r \x{85}\p{Z}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trimmed(column: str) -> str:
    left = f"regexp_replace({column}, {text('^' + SPACES + '+')}, '')"
    return f"regexp_replace({left}, {text(SPACES + '+$')}, '')"


# --- shared pieces -----------------------------------------------------------------

LOGS = f"logs AS ({duckdb_text(D.LOG_LINES)})"

# Continuation tests on the previous line p and the line l.
INDENTED = r"regexp_matches({c}, '^[ \t]')"
PYTHON_CONT = (
    "(l <> '' AND (" + INDENTED.format(c="l") + " OR (contains(l, ': ') AND "
    + INDENTED.format(c="p") + ")))"
)
JAVA_CONT = r"regexp_matches(l, '^[ \t]*(at |\.\.\. |Caused by:|Suppressed:)')"
GO_CONT = r"(l = '' OR regexp_matches(l, '^[ \t]|^goroutine |^exit status |^[^.]+\.(?s:.*)\('))"
NODE_CONT = r"regexp_matches(l, '^(    |\t)at ')"
RUBY_CONT = r"regexp_matches(l, '^[ \t]*from ')"
RULES = {
    "python": PYTHON_CONT,
    "java": JAVA_CONT,
    "go": GO_CONT,
    "node": NODE_CONT,
    "ruby": RUBY_CONT,
}
RULES["universal"] = "(l = '' OR " + " OR ".join(RULES.values()) + ")"


def records(rule: str = "universal", idle_us: int | None = None, logs: str = "logs") -> str:
    """CTEs that end in ``records``: lines grouped by running count of openings."""
    idle = f" AND epoch_us(ts) - epoch_us(pt) < {idle_us}" if idle_us else ""
    return f"""
pairs AS (SELECT *, line AS l, lag(line) OVER w AS p, lag(ts) OVER w AS pt FROM {logs}
  WINDOW w AS (PARTITION BY stream_key ORDER BY seq)),
marked AS (SELECT *, CASE WHEN p IS NOT NULL AND {RULES[rule]}{idle} THEN 0 ELSE 1 END AS opens FROM pairs),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY stream_key ORDER BY seq) AS g FROM marked),
records AS (SELECT stream_key, min(seq) AS seq, min_by(ts, seq) AS ts, min_by(file_path, seq) AS file_path,
  string_agg(line, {NL} ORDER BY seq) AS line, count(*) AS n_lines FROM numbered GROUP BY stream_key, g)"""


# Redaction patterns in RE2 form.
REDACTIONS = [
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[email]"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "[ip]"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[jwt]"),
    ("bearer", r"(?i)Bearer\s+[A-Za-z0-9_\-\.~+/=]+", "Bearer [token]"),
    ("stripe_key", r"\b(sk|pk|rk)_(test|live)_[A-Za-z0-9]{16,}\b", "[api_key]"),
    (
        "generic_api_key",
        r"""(?i)(api[_\-]?key["']?\s*[:=]\s*["']?)([A-Za-z0-9_\-]{16,})""",
        r"\1[api_key]",
    ),
]


def redacted(column: str, names: tuple[str, ...] = (), custom: tuple[str, ...] = ()) -> str:
    steps = [(p, m) for n, p, m in REDACTIONS if not names or n in names]
    steps += [(p, "[redacted]") for p in custom]
    for pattern, marker in steps:
        column = f"regexp_replace({column}, {text(pattern)}, {text(marker)}, 'g')"
    return column


# Trace shapes in RE2 form.
MARKER = "Traceback (most recent call last):"
PY_FRAME = r'^\s*File "([^"]+)", line (\d+), in (.+)$'
PY_EXC = r"^([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*):\s*(.*)$"
JAVA_HEAD = r'^(?:Exception in thread "[^"]+"\s+)?([\w$\.]+(?:Exception|Error|Throwable))(?::\s*(.*))?$'
JAVA_FRAME = r"^\s+at\s+(?:[\w./@$\-]+/)?([\w$\.]+)\(([^:)]*)(?::(\d+))?\)$"
GO_HEAD = r"^(panic|fatal error):\s*(.+)$"
GO_FUNC = r"^([\w./\-]+\.[\w\-]+)\(.*\)$"
GO_FILE = r"^\s+([^:\s]+\.go):(\d+)(?:\s+.*)?$"
NODE_HEAD = r"^(\w*Error):\s*(.*)$"
NODE_FRAME = r"^\s+at\s+(\S.*?)\s+\(([^):]+):(\d+):(\d+)\)$"
NODE_ANON = r"^\s+at\s+([^():]+):(\d+):(\d+)$"
RUBY_HEAD = r"^([^:]+):(\d+):in `([^']+)':\s*(.*?)\s*\(([\w:]+)\)$"
RUBY_FRAME = r"^\s+from\s+([^:]+):(\d+):in `([^']+)'$"


def hit(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {text(pattern)}), false)"


def part(column: str, pattern: str, n: int) -> str:
    return f"coalesce(regexp_extract({column}, {text(pattern)}, {n}), '')"


def line_no(digits: str) -> str:
    return f"coalesce(CAST(nullif(TRY_CAST({digits} AS BIGINT), 0) AS STRING), '')"


def frame(filename: str, function: str, line: str, context: str = "''") -> str:
    return f"concat_ws('|', {filename}, {function}, {line_no(line)}, {context})"


def pieces(source: str) -> str:
    return f"""
split AS (SELECT stream_key, seq, string_split(line, {NL}) AS s FROM {source}),
pieces AS (SELECT stream_key, seq, s[1] AS top, i, s[i + 1] AS line, s[i + 2] AS below
  FROM (SELECT *, unnest(range(len(s))) AS i FROM split))"""


BODY = trimmed("line")
NODE_IS_FRAME = f"({hit('line', NODE_FRAME)} OR {hit('line', NODE_ANON)})"
LANGUAGES = {
    "python": {
        "start": f"contains(line, {text(MARKER)})",
        "stop": hit("line", PY_EXC),
        "is_frame": hit("line", PY_FRAME),
        "frame": frame(
            part("line", PY_FRAME, 1),
            part("line", PY_FRAME, 3),
            part("line", PY_FRAME, 2),
            f"CASE WHEN starts_with(below, '    ') AND NOT {hit('below', PY_FRAME)} "
            f"THEN {trimmed('below')} ELSE '' END",
        ),
        "type": part("ending", PY_EXC, 1),
        "value": part("ending", PY_EXC, 2),
        "message": f"CASE WHEN ending IS NULL THEN {trimmed('top')} "
        f"ELSE {part('ending', PY_EXC, 1)} || ': ' || {part('ending', PY_EXC, 2)} END",
        "keep": "ending IS NOT NULL OR n > 0",
    },
    "java": {
        "start": f"{hit('line', JAVA_HEAD)} AND {hit('below', JAVA_FRAME)}",
        "stop": f"NOT {hit('line', JAVA_FRAME)} AND NOT starts_with({BODY}, '...') AND NOT "
        f"starts_with({BODY}, 'Caused by:') AND NOT starts_with({BODY}, 'Suppressed:') AND {BODY} <> ''",
        "is_frame": hit("line", JAVA_FRAME),
        "frame": frame(
            part("line", JAVA_FRAME, 2), part("line", JAVA_FRAME, 1), part("line", JAVA_FRAME, 3)
        ),
        "type": part("head", JAVA_HEAD, 1),
        "value": part("head", JAVA_HEAD, 2),
        "message": f"{part('head', JAVA_HEAD, 1)} || CASE WHEN {part('head', JAVA_HEAD, 2)} = '' "
        f"THEN '' ELSE ': ' || {part('head', JAVA_HEAD, 2)} END",
    },
    "go": {
        "start": hit("line", GO_HEAD),
        "stop": "false",
        "is_frame": hit("line", GO_FUNC),
        "frame": frame(
            part("below", GO_FILE, 1), part("line", GO_FUNC, 1), part("below", GO_FILE, 2)
        ),
        "type": f"CASE {part('head', GO_HEAD, 1)} WHEN 'panic' THEN 'PanicError' ELSE 'FatalError' END",
        "value": part("head", GO_HEAD, 2),
        "message": f"'panic: ' || {part('head', GO_HEAD, 2)}",
    },
    "node": {
        "start": f"{hit('ltrim(line, concat(chr(32), chr(9)))', NODE_HEAD)} AND "
        f"({hit('below', NODE_FRAME)} OR {hit('below', NODE_ANON)})",
        "stop": f"NOT {NODE_IS_FRAME} AND NOT " + hit("line", r"^(    |\t)at "),
        "is_frame": NODE_IS_FRAME,
        "frame": f"CASE WHEN {hit('line', NODE_FRAME)} THEN "
        + frame(part("line", NODE_FRAME, 2), part("line", NODE_FRAME, 1), part("line", NODE_FRAME, 3))
        + " ELSE "
        + frame(part("line", NODE_ANON, 1), "'<anonymous>'", part("line", NODE_ANON, 2))
        + " END",
        "type": part("ltrim(head, concat(chr(32), chr(9)))", NODE_HEAD, 1),
        "value": part("ltrim(head, concat(chr(32), chr(9)))", NODE_HEAD, 2),
        "message": part("ltrim(head, concat(chr(32), chr(9)))", NODE_HEAD, 1)
        + " || ': ' || "
        + part("ltrim(head, concat(chr(32), chr(9)))", NODE_HEAD, 2),
    },
    "ruby": {
        "start": hit("line", RUBY_HEAD),
        "stop": f"NOT {hit('line', RUBY_FRAME)}",
        "is_frame": f"(i = a OR {hit('line', RUBY_FRAME)})",
        "frame": f"CASE WHEN i = a THEN "
        + frame(part("line", RUBY_HEAD, 1), part("line", RUBY_HEAD, 3), part("line", RUBY_HEAD, 2))
        + " ELSE "
        + frame(part("line", RUBY_FRAME, 1), part("line", RUBY_FRAME, 3), part("line", RUBY_FRAME, 2))
        + " END",
        "type": part("head", RUBY_HEAD, 5),
        "value": part("head", RUBY_HEAD, 4),
        "message": f"{part('head', RUBY_HEAD, 5)} || ': ' || {part('head', RUBY_HEAD, 4)}",
        "first": "i >= a",
    },
}
EVENT_COLUMNS = "exc_type, exc_value, message, n_frames, frames"


def language(name: str) -> str:
    """CTEs that end in ``<name>_events``: start, stop, frames, then the header."""
    spec = LANGUAGES[name]
    first = spec.get("first", "i > a")
    return f"""
{name}_a AS (SELECT stream_key, seq, min(i) AS a FROM pieces WHERE {spec['start']} GROUP BY ALL),
{name}_b AS (SELECT stream_key, seq, a, min(i) FILTER (WHERE i > a AND {spec['stop']}) AS b
  FROM pieces JOIN {name}_a USING (stream_key, seq) GROUP BY ALL),
{name}_f AS (SELECT stream_key, seq,
    count(*) FILTER (WHERE ok) AS n, coalesce(string_agg(f, ';' ORDER BY i) FILTER (WHERE ok), '') AS frames,
    max(line) FILTER (WHERE i = a) AS head, max(line) FILTER (WHERE i = b) AS ending, any_value(top) AS top
  FROM (SELECT *, {first} AND (b IS NULL OR i < b) AND {spec['is_frame']} AS ok, {spec['frame']} AS f
    FROM pieces JOIN {name}_b USING (stream_key, seq)) GROUP BY ALL),
{name}_events AS (SELECT stream_key, seq, {spec['type']} AS exc_type, {spec['value']} AS exc_value,
    {spec['message']} AS message, n AS n_frames, frames FROM {name}_f WHERE {spec.get('keep', 'true')})"""


def json_string(record: str, *keys: str) -> str:
    """First non-empty string among the keys of a JSON value."""
    tries = [
        f"CASE WHEN json_type({record}, '$.{k}') = 'VARCHAR' "
        f"THEN nullif(json_extract_string({record}, '$.{k}'), '') END"
        for k in keys
    ]
    return f"coalesce({', '.join(tries)})" if len(tries) > 1 else tries[0]


def json_object(line: str) -> str:
    """JSON of a text that is one object, else NULL."""
    body = trimmed(line)
    return (
        f"CASE WHEN starts_with({body}, '{{') AND json_valid({body}) THEN CAST({body} AS JSON) END"
    )


def level(given: str) -> str:
    plain = f"lower({trimmed(given)})"
    return (
        f"CASE WHEN {plain} IN ('fatal', 'critical', 'crit') THEN 'fatal' "
        f"WHEN {plain} IN ('error', 'err') THEN 'error' "
        f"WHEN {plain} IN ('warn', 'warning') THEN 'warning' "
        f"WHEN {plain} IN ('info', 'notice') THEN 'info' "
        f"WHEN {plain} = 'debug' THEN 'debug' ELSE lower({given}) END"
    )


def micros(given: str) -> str:
    shape = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+\-]\d{2}:\d{2})$"
    return (
        f"CASE WHEN regexp_matches({given}, {text(shape)}) "
        f"THEN epoch_us(TRY_CAST(replace({given}, ',', '.') AS TIMESTAMPTZ)) END"
    )


LEVEL_GIVEN = json_string("j", "level", "severity")
MESSAGE_GIVEN = json_string("j", "message", "msg", "log")
EXC_TYPE = json_string("j", "exception.type", "exception.class")
EXC_VALUE = json_string("j", "exception.value", "exception.message")
FLAT_ERROR = json_string("j", "error", "err")
TRACE_IS_LIST = "json_type(j, '$.exception.stacktrace.frames') = 'ARRAY'"
IS_ERROR = f"{level(LEVEL_GIVEN)} IN ('fatal', 'error')"
PLATFORM = f"""coalesce({json_string('j', 'platform', 'language')},
  CASE WHEN regexp_matches({json_string('j', 'logger', 'logger_name')}, 'django|fastapi|flask') THEN 'python'
    WHEN regexp_matches({json_string('j', 'logger', 'logger_name')}, 'express|node') THEN 'node' END, 'unknown')"""
JSON_RECORDS = f"""json_lines AS ({duckdb_text(D.JSON_LINES)}),
records AS (SELECT event_id, j FROM (SELECT event_id, {json_object('line')} AS j FROM json_lines) WHERE j IS NOT NULL)"""


def cut(column: str, size: int) -> str:
    """First bytes of a text, with U+FFFD for each byte of a broken character."""
    h = f"hex(encode({column}))"

    def cont(n: int) -> str:
        return f"substr({h}, {2 * n - 1}, 2) BETWEEN '80' AND 'BF'"

    broken = (
        f"CASE WHEN NOT {cont(size + 1)} THEN 0 WHEN NOT {cont(size)} THEN 1 "
        f"WHEN NOT {cont(size - 1)} THEN 2 ELSE 3 END"
    )
    return (
        f"CASE WHEN octet_length(encode({column})) <= {size} THEN {column} ELSE "
        f"decode(unhex(substr({h}, 1, 2 * ({size} - {broken})))) || repeat(chr(65533), {broken}) END"
    )


def keyword(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(upper({column}), {text(w)})" for w in words) + ")"


KEYWORDS = ("ERROR", "FATAL", "PANIC", "EXCEPTION", "TRACEBACK")

def layers(source: str) -> str:
    """CTEs that end in ``found``: the layer each redacted record falls to."""
    return f"""
clean AS (SELECT stream_key, seq, ts, file_path, {redacted('line')} AS line FROM {source}),
{pieces('clean')}, {', '.join(language(n) for n in LANGUAGES)},
objects AS (SELECT stream_key, seq, j FROM (SELECT stream_key, seq, {json_object('line')} AS j FROM clean)
  WHERE j IS NOT NULL),
json_events AS (SELECT stream_key, seq, {level(LEVEL_GIVEN)} AS level, {PLATFORM} AS platform,
    {MESSAGE_GIVEN} AS message, {json_string('j', 'environment', 'env')} AS environment,
    {json_string('j', 'release', 'version', 'app_version')} AS release,
    {json_string('j', 'server_name', 'hostname', 'host')} AS server_name,
    CASE WHEN {FLAT_ERROR} IS NOT NULL THEN 'Error' END AS exc_type, {FLAT_ERROR} AS exc_value
  FROM objects WHERE {IS_ERROR}),
layered AS (
  SELECT stream_key, seq, 'json' AS parser, exc_type, exc_value, message, CAST(NULL AS BIGINT) AS n_frames,
    CAST(NULL AS STRING) AS frames, 1 AS rank FROM json_events
  {' '.join(f"UNION ALL SELECT stream_key, seq, '{n}', {EVENT_COLUMNS}, {i + 2} FROM {n}_events"
            for i, n in enumerate(LANGUAGES))}
  UNION ALL SELECT stream_key, seq, 'fallback', NULL, NULL, {cut(trimmed('line'), 8000)}, NULL, NULL, 9
    FROM clean WHERE {keyword('line', KEYWORDS)}),
found AS (SELECT * FROM layered QUALIFY row_number() OVER (PARTITION BY stream_key, seq ORDER BY rank) = 1)"""


LAYERED = f"{LOGS}, {records()}, {layers('records')}"

DIGEST = (
    "sha256(concat_ws(chr(31), stream_key, CAST(seq AS STRING), CAST(epoch_us(ts) AS STRING), line))"
)
EVENT_ID = " || '-' || ".join(
    f"substr({DIGEST}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
)
EVENTS = f"""{LAYERED},
events AS (SELECT f.stream_key, f.seq, {EVENT_ID.replace('stream_key', 'f.stream_key').replace('(seq', '(f.seq')} AS event_id,
    epoch_us(c.ts) AS timestamp_us, '{Q.PROJECT}' AS project_id,
    CASE f.parser WHEN 'json' THEN j.platform WHEN 'fallback' THEN 'unknown' ELSE f.parser END AS platform,
    coalesce(j.level, 'error') AS level, j.environment, j.release, j.server_name,
    nullif(f.message, '') AS message, f.exc_type, f.exc_value, f.n_frames, f.frames, f.parser,
    'file' AS log_source, c.file_path,
    CASE WHEN f.parser = 'fallback' THEN {cut('c.line', 200)} END AS raw_line
  FROM found f JOIN clean c ON c.stream_key = f.stream_key AND c.seq = f.seq
  LEFT JOIN json_events j ON j.stream_key = f.stream_key AND j.seq = f.seq AND f.parser = 'json')"""

PODS = f"""pods AS (SELECT *, string_split(dirname, '_') AS parts FROM ({duckdb_text(D.POD_LINES)})),
decoded AS (SELECT *, parts[1] AS namespace, array_to_string(parts[2:len(parts) - 1], '_') AS pod,
  parts[len(parts)] AS uid FROM pods WHERE len(parts) >= 3)"""
DEPLOYMENT = r"regexp_replace(pod, '^(.*)-[a-z0-9]{4,10}-[a-z0-9]{4,10}$', '\1')"
SYSTEM = "namespace NOT IN ('kube-system', 'kube-public', 'kube-node-lease'"


def field(key: str) -> str:
    return (
        f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' THEN json_extract_string(j, '$.{key}') END"
    )


JOURNAL = f"""entries AS (SELECT seq, ts, {json_object('line')} AS j FROM ({duckdb_text(D.JOURNAL_LINES)})),
fields AS (SELECT seq, ts, coalesce({field('_SYSTEMD_UNIT')}, {field('UNIT')}, '') AS unit,
  {field('MESSAGE')} AS line, coalesce({field('_HOSTNAME')}, '') AS hostname,
  coalesce({field('PRIORITY')}, '') AS priority, {field('__REALTIME_TIMESTAMP')} AS us
  FROM entries WHERE j IS NOT NULL),
journal AS (SELECT * FROM fields WHERE line <> ''
  AND NOT regexp_matches(unit, '^(systemd-|dbus\\.|polkit\\.)'))"""

OTLP = f"""requests AS (SELECT seq, ts, {json_object('payload')} AS j FROM ({duckdb_text(D.OTLP_REQUESTS)})),
resources AS (SELECT seq, ts, r, ri FROM (SELECT seq, ts,
    unnest(CAST(json_extract(j, '$.resourceLogs') AS JSON[])) AS r,
    unnest(range(CAST(json_array_length(j, '$.resourceLogs') AS BIGINT))) AS ri FROM requests WHERE j IS NOT NULL)),
scopes AS (SELECT seq, ts, r, ri, unnest(CAST(json_extract(r, '$.scopeLogs') AS JSON[])) AS s,
    unnest(range(CAST(json_array_length(r, '$.scopeLogs') AS BIGINT))) AS si FROM resources),
nested AS (SELECT seq, ts, r, ri, s, si, unnest(CAST(json_extract(s, '$.logRecords') AS JSON[])) AS x,
    unnest(range(CAST(json_array_length(s, '$.logRecords') AS BIGINT))) AS xi FROM scopes),
attributes AS (SELECT seq, ri, json_extract_string(a, '$.key') AS k,
    coalesce(json_extract_string(a, '$.value.stringValue'), json_extract_string(a, '$.value.intValue'), '') AS v, ai
  FROM (SELECT seq, ri, unnest(CAST(json_extract(r, '$.resource.attributes') AS JSON[])) AS a,
    unnest(range(CAST(json_array_length(r, '$.resource.attributes') AS BIGINT))) AS ai FROM resources)),
promoted AS (SELECT seq, ri, max_by(v, ai) FILTER (WHERE k = 'service.name') AS service_name,
    max_by(v, ai) FILTER (WHERE k = 'host.name') AS hostname FROM attributes GROUP BY ALL),
otlp AS (SELECT n.seq, row_number() OVER (PARTITION BY n.seq ORDER BY n.ri, si, xi) - 1 AS place,
    coalesce(json_extract_string(x, '$.body.stringValue'), json_extract_string(x, '$.body.intValue'),
      json_extract_string(x, '$.body.boolValue'), '') AS line, n.ts AS arrival,
    json_extract_string(x, '$.timeUnixNano') AS ns,
    coalesce(json_extract_string(x, '$.severityText'), '') AS sev_text,
    CAST(json_extract_string(x, '$.severityNumber') AS INT) AS sev,
    json_extract_string(s, '$.scope.name') AS otel_scope, json_extract_string(x, '$.traceId') AS trace_id,
    json_extract_string(x, '$.spanId') AS span_id, service_name, p.hostname
  FROM nested n LEFT JOIN promoted p ON p.seq = n.seq AND p.ri = n.ri)"""
SEVERITY = """CASE WHEN sev_text <> '' THEN sev_text WHEN coalesce(sev, 0) <= 0 THEN '' WHEN sev >= 21 THEN 'FATAL'
  WHEN sev >= 17 THEN 'ERROR' WHEN sev >= 13 THEN 'WARN' WHEN sev >= 9 THEN 'INFO' WHEN sev >= 5 THEN 'DEBUG'
  ELSE 'TRACE' END"""

CHUNKS = f"chunks AS ({duckdb_text(D.CONTAINER_CHUNKS_DUCKDB)})"
CONTAINER_LINES = f"""{CHUNKS},
whole AS (SELECT container_id, source, string_split(string_agg(payload, '' ORDER BY chunk_no), {NL}) AS s
  FROM chunks GROUP BY ALL),
lines AS (SELECT container_id, source, i AS line_no, s[i + 1] AS line
  FROM (SELECT *, unnest(range(len(s) - 1)) AS i FROM whole))"""

# One row per event in limiter order, folded one event at a time.


def limiter(arrivals: str, rate: int, burst: int) -> str:
    refill = f"least({burst}000000, tokens + {rate} * (greatest(n.micros, s.micros) - s.micros))"
    return f"""RECURSIVE arrivals AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn
  FROM ({arrivals})),
steps AS (SELECT source, rn, seq, event_type, micros, {burst}000000 - 1000000 AS tokens, true AS allowed
    FROM arrivals WHERE rn = 1
  UNION ALL SELECT n.source, n.rn, n.seq, n.event_type, greatest(n.micros, s.micros),
    CASE WHEN {refill} >= 1000000 THEN {refill} - 1000000 ELSE {refill} END, {refill} >= 1000000
  FROM steps s JOIN arrivals n ON n.source = s.source AND n.rn = s.rn + 1)"""


LIMITED = limiter(duckdb_text(D.ARRIVALS_DUCKDB), Q.LIMIT["rate"], Q.LIMIT["burst"])
STATS = "(SELECT source AS limiter_key, count(*) FILTER (WHERE allowed) AS allowed, " \
    "count(*) FILTER (WHERE NOT allowed) AS dropped FROM steps GROUP BY source)"

QUEUE = f"queue AS ({duckdb_text(D.QUEUE_DUCKDB)})"
REPLAYED = f"""{QUEUE},
stops AS (SELECT queue, min(seq) AS stop FROM queue WHERE failed AND NOT corrupt GROUP BY queue),
replayed AS (SELECT q.queue, seq, CASE WHEN seq >= stop THEN 'remaining' WHEN corrupt THEN 'discarded'
  ELSE 'delivered' END AS action FROM queue q LEFT JOIN stops s ON s.queue = q.queue)"""
ENTRY_SEQ = (
    "CASE WHEN regexp_matches(name, '^\\d{20}\\.json$') THEN TRY_CAST(substr(name, 1, 20) AS BIGINT) END"
)
ATTEMPTS = f"""attempts AS ({duckdb_text(D.ATTEMPTS)}),
tried AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN status BETWEEN 400 AND 499
  THEN 'permanent' END AS terminal FROM attempts WHERE attempt <= 6),
ends AS (SELECT event_id, min(attempt) AS ended FROM tried WHERE terminal IS NOT NULL GROUP BY event_id),
lasts AS (SELECT event_id, max(attempt) AS tried FROM tried GROUP BY event_id)"""
WAIT = "CASE WHEN {n} <= 1 THEN 0 ELSE CAST(least(60, pow(2, least({n} - 2, 10))) AS BIGINT) END"
HEALTH = f"""reports AS ({duckdb_text(D.REPORTS)}),
health AS (SELECT source, CAST(sum(emitted) AS BIGINT) AS emitted, CAST(sum(dropped) AS BIGINT) AS dropped,
  nullif(max_by(last_error, last_error_at), '') AS last_error FROM reports GROUP BY source)"""

DEF = r"^([ \t]*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
CODE = f"""files AS ({duckdb_text(D.SOURCE_FILES)}),
code AS (SELECT repo, path, s, i, s[i] AS line, ltrim(s[i], concat(chr(32), chr(9))) AS body
  FROM (SELECT repo, path, s, unnest(range(1, len(s) + 1)) AS i
    FROM (SELECT repo, path, string_split(content, {NL}) AS s FROM files))),
marks AS (SELECT *, length(line) - length(body) AS indent, body <> '' AND NOT starts_with(body, '#') AS live FROM code),
defs AS (SELECT * FROM marks WHERE {hit('line', DEF)}),
ends AS (SELECT d.path, d.i, min(m.i) AS stop FROM defs d JOIN marks m
  ON m.path = d.path AND m.i > d.i AND m.live AND m.indent <= d.indent GROUP BY ALL),
chunks AS (SELECT repo, d.path AS file_path, d.i AS start_line, coalesce(stop - 1, len(s)) AS end_line,
    {part('line', DEF, 2)} AS name,
    CASE WHEN {hit('line', '^[^(]*[(](self|cls)([,) \t:]|$)')} THEN 'method' ELSE 'function' END AS kind,
    array_to_string(s[d.i:coalesce(stop - 1, len(s))], {NL}) AS content
  FROM defs d LEFT JOIN ends e ON e.path = d.path AND e.i = d.i)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- sources -----------------------------------------------------------------------

oracle(
    "text_log_source",
    f"SELECT source AS folder, 'file' AS source, unnest(string_split(text, {NL})) AS line FROM documents",
)
oracle(
    "pod_log_source",
    f"""WITH {PODS} SELECT concat('k8s:', pod, '/app') AS stream_key, 'kubernetes' AS source, seq, line,
    namespace AS k8s_namespace, pod AS k8s_pod, uid AS k8s_pod_uid, {DEPLOYMENT} AS k8s_deployment,
    'app' AS container_name FROM decoded WHERE {SYSTEM}, 'staging')""",
)
oracle("pod_dir_decode", f"WITH {PODS} SELECT seq, namespace, pod, uid FROM decoded")
oracle(
    "deployment_name",
    f"WITH {PODS} SELECT seq, pod, {DEPLOYMENT} AS deployment FROM (SELECT seq, parts[2] AS pod FROM pods)",
)
oracle(
    "namespace_exclusion",
    f"""WITH {PODS} SELECT namespace, count(*) AS n FROM (SELECT parts[1] AS namespace FROM pods)
    WHERE {SYSTEM}, 'staging') GROUP BY namespace""",
)
oracle(
    "journal_entries",
    f"""WITH {JOURNAL} SELECT 'journald' AS source, seq, line, unit AS systemd_unit, hostname, priority
    FROM journal""",
)
oracle(
    "journal_units",
    f"WITH {JOURNAL} SELECT seq, unit FROM journal WHERE unit IN ('nginx.service', 'dbus.service')",
)
oracle(
    "journal_rejects",
    f"""SELECT seq, line FROM ({duckdb_text(D.JOURNAL_LINES)}) WHERE {json_object('line')} IS NULL""",
)
oracle(
    "journal_time",
    f"""WITH {JOURNAL} SELECT seq, CASE WHEN regexp_matches(us, '^[0-9]+$') THEN CAST(us AS BIGINT)
    ELSE epoch_us(ts) END AS micros FROM journal""",
)
oracle("otlp_records", f"WITH {OTLP} SELECT 'otel' AS source, seq, place, line FROM otlp")
oracle(
    "otlp_rejects",
    f"""SELECT seq, payload FROM ({duckdb_text(D.OTLP_REQUESTS)}) WHERE NOT json_valid(payload)""",
)
oracle("otlp_value_text", f"WITH {OTLP} SELECT line, count(*) AS n FROM otlp GROUP BY line")
oracle(
    "otlp_time",
    f"""WITH {OTLP} SELECT seq, place, CASE WHEN regexp_matches(ns, '^[0-9]+$')
    THEN CAST(ns AS BIGINT) // 1000 ELSE epoch_us(arrival) END AS micros FROM otlp""",
)
oracle(
    "otlp_severity",
    f"WITH {OTLP} SELECT {SEVERITY} AS severity, count(*) AS n FROM otlp GROUP BY ALL",
)
oracle(
    "otlp_tags",
    f"""WITH {OTLP} SELECT seq, place, {SEVERITY} AS otel_severity, otel_scope, trace_id, span_id,
    service_name, hostname, 1 + (otel_scope IS NOT NULL)::BIGINT + (trace_id IS NOT NULL)::BIGINT
    + (span_id IS NOT NULL)::BIGINT + (service_name IS NOT NULL)::BIGINT + (hostname IS NOT NULL)::BIGINT AS n_tags
    FROM otlp""",
)
oracle("container_lines", f"WITH {CONTAINER_LINES} SELECT container_id, line_no, line FROM lines")
oracle(
    "container_names",
    f"""WITH {CHUNKS} SELECT container_id, name, count(*) AS chunks FROM (SELECT container_id,
    CASE WHEN source = 'src3' THEN 'unknown' ELSE source END AS name FROM chunks)
    WHERE name NOT IN ('src5', 'src7') GROUP BY ALL""",
)
oracle(
    "container_starts",
    f"""SELECT container_id, max_by(name, seq) FILTER (WHERE status = 'start') AS name
    FROM ({duckdb_text(D.CONTAINER_EVENTS)}) WHERE status IN ('start', 'die')
    GROUP BY container_id HAVING max_by(status, seq) = 'start'""",
)
oracle(
    "source_union",
    f"""WITH {LOGS}, {JOURNAL}, {PODS}, {OTLP}, {CONTAINER_LINES}, raw AS (
    SELECT source, stream_key, line FROM logs
    UNION ALL SELECT 'journald', concat('journald:', unit), line FROM journal
    UNION ALL SELECT 'kubernetes', concat('k8s:', pod, '/app'), line FROM decoded WHERE {SYSTEM})
    UNION ALL SELECT 'otel', 'otel', line FROM otlp
    UNION ALL SELECT 'docker', concat('docker:', source), line FROM lines)
    SELECT source, stream_key, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM raw GROUP BY ALL""",
)
oracle(
    "shared_names",
    f"""WITH {LOGS}, {JOURNAL}, {CONTAINER_LINES}, shared AS (
    SELECT stream_key AS name, config AS origin, seq, line FROM logs, (VALUES ('0'), ('4')) AS c(config)
    UNION ALL SELECT concat('journald:', unit), config, seq, line FROM journal, (VALUES ('1'), ('3')) AS c(config)
    UNION ALL SELECT 'docker:app', concat('2', container_id), line_no, line FROM lines),
    one_each AS (SELECT concat(name, chr(31), origin) AS stream_key, seq, TIMESTAMP '1970-01-01' AS ts,
        '' AS file_path, rtrim(coalesce(line, ''), {NL}) AS line FROM shared),
    {records(logs="one_each")}
    SELECT string_split(stream_key, chr(31))[1] AS stream_key, count(*) AS records,
    count(DISTINCT string_split(stream_key, chr(31))[2]) AS origins, CAST(sum(n_lines) AS BIGINT) AS lines,
    CAST(sum(length(line)) AS BIGINT) AS chars FROM records GROUP BY 1""",
)
oracle(
    "source_tree_paths",
    f"""SELECT path FROM ({duckdb_text(D.TREE_PATHS)}) WHERE regexp_matches(path, '\\.py$') AND NOT
    regexp_matches(path, '(^|/)(\\.git|node_modules|__pycache__|\\.venv|venv|\\.tox|site-packages|dist|build|\\.next|\\.cache)/')""",
)
oracle(
    "envelope_sink",
    f"""WITH {EVENTS} SELECT stream_key, seq, concat_ws(',', 'event_id', 'timestamp', 'project_id', 'platform',
    'level', CASE WHEN environment IS NOT NULL THEN 'environment' END, CASE WHEN release IS NOT NULL THEN 'release' END,
    CASE WHEN server_name IS NOT NULL THEN 'server_name' END, CASE WHEN message IS NOT NULL THEN 'message' END,
    CASE WHEN exc_type IS NOT NULL THEN 'exception' END, 'tags') AS keys,
    strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, level, message, exc_type,
    nullif(string_split(string_split(frames, ';')[1], '|')[3], '') AS line0, parser, file_path FROM events""",
)
oracle(
    "chunk_batches",
    f"""WITH {CODE}, ranked AS (SELECT *, (row_number() OVER (PARTITION BY repo
    ORDER BY string_split(file_path, '/'), start_line) - 1) // 50 AS batch_no FROM chunks),
    batches AS (SELECT repo, batch_no, false AS done, count(*) AS n_chunks, string_agg(concat_ws(':', file_path,
    start_line, name), ',' ORDER BY string_split(file_path, '/'), start_line) AS chunks FROM ranked GROUP BY ALL
    UNION ALL SELECT r.repo, (count(c.repo) + 49) // 50, true, 0, '' FROM (SELECT DISTINCT repo FROM files) r
    LEFT JOIN chunks c ON c.repo = r.repo GROUP BY r.repo)
    SELECT repo AS repo_name, concat('https://git/', repo) AS repo_url, 'main' AS branch,
    sha256(repo) AS source_sha, batch_no, done, n_chunks, chunks FROM batches""",
)

# --- row transforms ------------------------------------------------------------------

oracle(
    "stream_keys",
    f"""SELECT event_id, CASE WHEN coalesce(pod, '') <> '' THEN concat('k8s:', pod, '/', coalesce(box, ''))
    WHEN coalesce(box, '') <> '' THEN concat('docker:', box) WHEN coalesce(unit, '') <> ''
    THEN concat('journald:', unit) WHEN coalesce(file_path, '') <> '' THEN concat('file:', file_path)
    ELSE source END AS stream_key FROM ({duckdb_text(D.TAGGED)})""",
)
oracle("redact_text", f"SELECT doc_id, {redacted('text')} AS text FROM documents")
oracle(
    "redact_secrets",
    f"SELECT event_id, {redacted('line')} AS line FROM ({duckdb_text(D.SECRETS)})",
)
oracle("redact_selected", f"SELECT doc_id, {redacted('text', Q.FILE_SUBSET)} AS text FROM documents")
oracle(
    "redact_custom",
    f"""SELECT doc_id, {redacted('text', custom=tuple(p for p in Q.CUSTOM_REDACTIONS if p != '('))} AS text
    FROM documents""",
)
oracle(
    "normalise_levels",
    f"WITH {JSON_RECORDS} SELECT event_id, {LEVEL_GIVEN} AS given, {level(LEVEL_GIVEN)} AS level FROM records",
)
oracle(
    "error_levels",
    f"WITH {JSON_RECORDS} SELECT event_id, {level(LEVEL_GIVEN)} AS level FROM records WHERE {IS_ERROR}",
)
oracle("first_strings", f"WITH {JSON_RECORDS} SELECT event_id, {MESSAGE_GIVEN} AS message FROM records")
oracle(
    "json_events",
    f"""WITH {JSON_RECORDS} SELECT event_id, {level(LEVEL_GIVEN)} AS level, {MESSAGE_GIVEN} AS message,
    {json_string('j', 'environment', 'env')} AS environment,
    {json_string('j', 'release', 'version', 'app_version')} AS release,
    {json_string('j', 'server_name', 'hostname', 'host')} AS server_name FROM records WHERE {IS_ERROR}""",
)
TIME_GIVEN = json_string("j", "timestamp", "ts", "time")
oracle(
    "json_time",
    f"WITH {JSON_RECORDS} SELECT event_id, {TIME_GIVEN} AS given, {micros(TIME_GIVEN)} AS micros FROM records",
)
oracle(
    "json_exception",
    f"""WITH {JSON_RECORDS}, parts AS (SELECT event_id, {EXC_TYPE} AS t, {EXC_VALUE} AS v, {FLAT_ERROR} AS flat,
    coalesce({TRACE_IS_LIST}, false) AS listed FROM records WHERE {IS_ERROR})
    SELECT event_id, CASE WHEN t IS NULL AND v IS NULL THEN 'Error' ELSE coalesce(t, '') END AS exc_type,
    CASE WHEN t IS NULL AND v IS NULL THEN flat ELSE coalesce(v, '') END AS exc_value,
    (t IS NOT NULL OR v IS NOT NULL) AND listed AS has_trace FROM parts
    WHERE coalesce(t, v, flat) IS NOT NULL""",
)
NUMBER = "CASE WHEN json_type(f, '$.lineno') IN ('UBIGINT', 'BIGINT', 'DOUBLE') " \
    "THEN nullif(CAST(trunc(CAST(json_extract(f, '$.lineno') AS DOUBLE)) AS BIGINT), 0) END"
oracle(
    "json_frame_list",
    f"""WITH {JSON_RECORDS}, frames AS (SELECT event_id,
    unnest(CAST(json_extract(j, '$.exception.stacktrace.frames') AS JSON[])) AS f,
    unnest(range(CAST(json_array_length(j, '$.exception.stacktrace.frames') AS BIGINT))) AS i FROM records WHERE {TRACE_IS_LIST})
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS place,
    coalesce({json_string('f', 'filename', 'file')}, '') AS filename,
    coalesce({json_string('f', 'function', 'func', 'method')}, '') AS function, {NUMBER} AS lineno,
    {json_string('f', 'context_line', 'line', 'code')} AS context_line FROM frames WHERE json_type(f) = 'OBJECT'""",
)
oracle("json_platform", f"WITH {JSON_RECORDS} SELECT event_id, {PLATFORM} AS platform FROM records")
for query_name, lang in (
    ("python_tracebacks", "python"),
    ("java_throwables", "java"),
    ("go_panics", "go"),
    ("node_stacks", "node"),
    ("ruby_traces", "ruby"),
):
    oracle(
        query_name,
        f"WITH {LOGS}, {records()}, {pieces('records')}, {language(lang)} "
        f"SELECT stream_key, seq, {EVENT_COLUMNS} FROM {lang}_events",
    )
oracle(
    "keyword_fallback",
    f"""SELECT doc_id, {cut('body', 8000)} AS message, {cut('text', 200)} AS raw_line
    FROM (SELECT doc_id, text, {trimmed('text')} AS body FROM ({duckdb_text(D.NOTES)}))
    WHERE {keyword('text', KEYWORDS)}""",
)
oracle(
    "custom_keywords",
    f"""WITH {LOGS}, {records()} SELECT stream_key, seq, {cut(trimmed('line'), 8000)} AS message
    FROM records WHERE {keyword('line', Q.CUSTOM_KEYWORDS)}""",
)
oracle(
    "custom_layer",
    f"""SELECT seq, CASE WHEN own THEN 'oops' ELSE 'fallback' END AS parser,
      CASE WHEN own THEN 'warning' ELSE 'error' END AS level, CASE WHEN own THEN line[6:] ELSE line END AS message
    FROM (SELECT seq, line, line LIKE 'OOPS%' AS own FROM ({duckdb_text(D.OOPS)})) WHERE line <> 'all is fine'""",
)
oracle(
    "layered_events",
    f"WITH {LAYERED} SELECT stream_key, seq, parser, {EVENT_COLUMNS} FROM found",
)
oracle(
    "trace_shapes",
    f"""WITH traces AS ({duckdb_text(D.TRACES)}), {layers('traces')}
    SELECT seq, parser, {EVENT_COLUMNS} FROM found""",
)
oracle(
    "layered_prefilter",
    f"WITH {LAYERED} SELECT count(*) AS events, count(*) AS events_kept FROM found",
)
oracle(
    "event_tags",
    f"""WITH {EVENTS} SELECT stream_key, seq, tag, value FROM (
    SELECT stream_key, seq, 'parser' AS tag, parser AS value FROM events
    UNION ALL SELECT stream_key, seq, 'log_source', log_source FROM events
    UNION ALL SELECT stream_key, seq, 'file_path', file_path FROM events
    UNION ALL SELECT stream_key, seq, 'raw_line', raw_line FROM events WHERE raw_line IS NOT NULL)""",
)
oracle(
    "error_events",
    f"""WITH {EVENTS} SELECT stream_key, seq, event_id, timestamp_us, project_id, platform, level, environment,
    release, server_name, message, exc_type, exc_value, frames, parser, log_source FROM events""",
)

# --- ordered and stateful operators ----------------------------------------------------

RECORD_COLUMNS = "stream_key, seq, epoch_us(ts) AS micros, line, n_lines"
oracle("recombine_lines", f"WITH {LOGS}, {records()} SELECT {RECORD_COLUMNS} FROM records")
oracle(
    "recombine_hot_stream",
    f"""WITH {LOGS}, hot AS (SELECT * REPLACE ('all' AS stream_key) FROM logs), {records(logs='hot')}
    SELECT {RECORD_COLUMNS} FROM records""",
)
oracle(
    "continuation_rules",
    f"WITH {LOGS}, pairs AS (SELECT *, line AS l, lag(line) OVER (PARTITION BY stream_key ORDER BY seq) AS p FROM logs), "
    + "opened AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, stream_key, seq, CASE WHEN p IS NOT NULL AND {test} THEN 0 ELSE 1 END AS opens FROM pairs"
        for name, test in RULES.items()
    )
    + """), grouped AS (SELECT rule, stream_key, sum(opens) OVER (PARTITION BY rule, stream_key ORDER BY seq) AS g FROM opened),
    sizes AS (SELECT rule, stream_key, g, count(*) AS n FROM grouped GROUP BY ALL)
    SELECT rule, stream_key, count(*) AS records, max(n) AS longest FROM sizes GROUP BY ALL""",
)
PRESSED = (
    f"pressed AS (SELECT * REPLACE (make_timestamp(epoch_us(ts) // {Q.TIME_PRESS}) AS ts) FROM logs)"
)
oracle(
    "recombine_idle",
    f"""WITH {LOGS}, {PRESSED}, {records(idle_us=Q.IDLE_MS * 1000, logs='pressed')}
    SELECT {RECORD_COLUMNS} FROM records""",
)
oracle(
    "recombine_streaming",
    f"WITH {LOGS}, {records()} SELECT {RECORD_COLUMNS} FROM records",
)
oracle(
    "rate_limit",
    f"WITH {LIMITED} SELECT source AS limiter_key, seq, event_type, allowed FROM steps",
)
oracle(
    "rate_limit_global",
    f"""WITH {limiter(f"SELECT 'all' AS source, seq, event_type, micros FROM ({duckdb_text(D.ARRIVALS_DUCKDB)})", 3, 5)}
    SELECT seq, allowed FROM steps""",
)
oracle(
    "rate_limit_streaming", f"WITH {LIMITED} SELECT source AS limiter_key, seq, allowed FROM steps"
)
# Batch by batch: what a key has left, with the minute's refill, lets so many of its events pass.
_TOKEN, _FULL, _MINUTE = 1_000_000, Q.LIMIT["burst"] * 1_000_000, Q.LIMIT["rate"] * D.BATCH_MICROS
oracle(
    "rate_limit_batches",
    f"""WITH RECURSIVE arrivals AS ({duckdb_text(D.BATCHED_ARRIVALS)}),
    counted AS (SELECT source, batch, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY batch) AS i
        FROM arrivals GROUP BY source, batch),
    buckets(source, batch, i, tokens, n) AS (
        SELECT source, batch, i, CAST({_FULL + _MINUTE} AS BIGINT), n FROM counted WHERE i = 1
        UNION ALL
        SELECT c.source, c.batch, c.i, CAST(least({_FULL}, b.tokens - least(b.n, b.tokens // {_TOKEN}) * {_TOKEN}
            + (c.batch - b.batch - 1) * {_MINUTE}) + {_MINUTE} AS BIGINT), c.n
        FROM buckets b JOIN counted c ON c.source = b.source AND c.i = b.i + 1)
    SELECT source AS limiter_key, batch, seq, row_number() OVER (PARTITION BY source, batch ORDER BY seq)
        <= tokens // {_TOKEN} AS allowed FROM arrivals JOIN buckets USING (source, batch)""",
)
oracle("limiter_stats", f"WITH {LIMITED} SELECT limiter_key, allowed, dropped FROM {STATS}")
oracle(
    "sample_rate",
    f"""WITH {LIMITED} SELECT limiter_key, CASE WHEN allowed = 0 THEN 1 ELSE (allowed + dropped) // allowed END
    AS sample_rate FROM {STATS}""",
)
oracle(
    "queue_retention",
    f"""WITH {QUEUE} SELECT queue, seq, bytes FROM queue QUALIFY
    sum(bytes) OVER (PARTITION BY queue ORDER BY seq DESC) <= {Q.RETAIN_BYTES}
    OR row_number() OVER (PARTITION BY queue ORDER BY seq DESC) = 1""",
)
oracle("queue_replay", f"WITH {REPLAYED} SELECT queue, seq, action FROM replayed")
oracle(
    "queue_replay_counts",
    f"""WITH {REPLAYED} SELECT queue, count(*) FILTER (WHERE action = 'delivered') AS delivered,
    count(*) FILTER (WHERE action = 'discarded') AS discarded,
    count(*) FILTER (WHERE action = 'remaining') AS remaining FROM replayed GROUP BY queue""",
)
oracle(
    "queue_order",
    f"""SELECT * FROM (SELECT queue, name, {ENTRY_SEQ} AS entry_seq FROM ({duckdb_text(D.QUEUE_NAMES)}))
    WHERE entry_seq IS NOT NULL""",
)
oracle(
    "queue_resume",
    f"""WITH tops AS (SELECT queue, max({ENTRY_SEQ}) AS top FROM ({duckdb_text(D.QUEUE_NAMES)}) GROUP BY queue)
    SELECT a.queue, seq, coalesce(top, 0) + row_number() OVER (PARTITION BY a.queue ORDER BY seq) AS entry_seq
    FROM ({duckdb_text(D.QUEUE_ARRIVALS)}) a LEFT JOIN tops t ON t.queue = a.queue""",
)
oracle(
    "queue_occupancy",
    f"""WITH {QUEUE} SELECT queue, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes,
    CAST({Q.RETAIN_BYTES} AS BIGINT) AS cap FROM queue GROUP BY queue""",
)
oracle(
    "delivery_outcomes",
    f"""WITH {ATTEMPTS} SELECT l.event_id, coalesce(t.terminal, CASE WHEN l.tried > 5 THEN 'exhausted'
    ELSE 'pending' END) AS outcome, coalesce(ended, l.tried) AS attempts, CAST(t.status AS BIGINT) AS last_status
    FROM lasts l LEFT JOIN ends e ON e.event_id = l.event_id JOIN tried t ON t.event_id = l.event_id
    AND t.attempt = coalesce(ended, l.tried)""",
)
oracle(
    "backoff_schedule",
    f"""WITH {ATTEMPTS} SELECT event_id, attempt, {WAIT.format(n='attempt')} AS wait_seconds,
    CAST(list_sum(list_transform(range(1, attempt + 1), lambda n: {WAIT.format(n='n')})) AS BIGINT) AS waited_seconds
    FROM attempts""",
)
oracle(
    "source_health",
    f"""WITH {HEALTH} SELECT source, last_error IS NULL AS healthy, emitted, dropped, last_error FROM health""",
)
oracle(
    "overall_health",
    f"""WITH {HEALTH} SELECT CASE WHEN count(last_error) > 0 THEN 'degraded' ELSE 'ok' END AS status,
    count(*) AS sources, count(last_error) AS unhealthy FROM health""",
)

# --- source code -------------------------------------------------------------------------

oracle(
    "function_chunks",
    f"WITH {CODE} SELECT repo, file_path, name, start_line, 'python' AS language, content FROM chunks",
)
oracle("function_ends", f"WITH {CODE} SELECT file_path, start_line, end_line FROM chunks")
oracle("chunk_kinds", f"WITH {CODE} SELECT repo, kind, count(*) AS n FROM chunks GROUP BY ALL")
oracle(
    "chunk_hashes",
    f"WITH {CODE} SELECT file_path, start_line, sha256(file_path || {NL} || content) AS content_hash FROM chunks",
)
oracle(
    "chunk_accounting",
    f"""WITH {CODE}, batches AS (SELECT repo, CAST(regexp_extract(file_path, 'f(\\d+)\\.py', 1) AS BIGINT) AS batch_no,
    count(*) AS n FROM chunks GROUP BY ALL),
    fails AS (SELECT repo, min(batch_no) AS f FROM batches WHERE batch_no % 41 = 40 GROUP BY repo)
    SELECT b.repo, CAST(coalesce(sum(n) FILTER (WHERE f IS NULL OR batch_no < f), 0) AS BIGINT) AS shipped,
    CAST(coalesce(sum(n) FILTER (WHERE batch_no >= f), 0) AS BIGINT) AS dropped
    FROM batches b LEFT JOIN fails x ON x.repo = b.repo GROUP BY b.repo""",
)
oracle(
    "frame_lookup",
    f"""WITH {CODE}, frames AS ({duckdb_text(D.FRAMES)})
    SELECT event_id, filename, lineno, name AS chunk_name, kind AS chunk_kind, start_line AS chunk_start_line,
    end_line AS chunk_end_line FROM frames LEFT JOIN chunks ON file_path = filename
    AND lineno BETWEEN start_line AND end_line
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY start_line DESC) = 1""",
)
