"""OTLP log export requests in their JSON encoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.once import with_once
from faultline.functions.text import blank_to_null, let
from faultline.functions.variants import JSON_SPACE, sealed
from faultline.sources.text import number_stream_rows, raw_log, read_text_files

ANY_VALUE = (
    "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
)
ATTRIBUTES = f"array<struct<key:string,value:{ANY_VALUE}>>"
REQUEST_FIELDS = (
    f"struct<resourceLogs:array<struct<resource:struct<attributes:{ATTRIBUTES}>,"
    "scopeLogs:array<struct<scope:struct<name:string,version:string>,"
    "logRecords:array<struct<timeUnixNano:string,severityNumber:int,"
    f"severityText:string,body:{ANY_VALUE},attributes:{ATTRIBUTES},"
    "traceId:string,spanId:string>>>>>>,seal:bigint>"
)
REQUEST = f"array<{REQUEST_FIELDS}>"
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Lowest number of each severity band, highest first.
SEVERITY_BANDS = ((21, "FATAL"), (17, "ERROR"), (13, "WARN"), (9, "INFO"), (5, "DEBUG"))
# Resource attributes that become tags.
PROMOTED = {
    "service.name": "service_name",
    "service.namespace": "service_namespace",
    "service.version": "service_version",
    "host.name": "hostname",
    "deployment.environment": "environment",
}


def severity_band(number: Column) -> Column:
    """Name of a severity number's band."""
    band = F.lit("TRACE")
    for lowest, name in reversed(SEVERITY_BANDS):
        band = F.when(number >= lowest, name).otherwise(band)
    return band


def severity(text: Column, number: Column) -> Column:
    """The text when there is one, else the band of a positive number, else empty."""
    return F.coalesce(
        blank_to_null(text), F.when(number > 0, severity_band(number)), F.lit("")
    )


def general_number(value: Column) -> Column:
    """A DOUBLE in ``%g`` style: shortest digits, exponent form outside 1e-4..1e6."""

    def render(text: Column) -> Column:
        sign = F.regexp_extract(text, "^(-?)", 1)
        whole = F.regexp_extract(text, r"^-?(\d+)", 1)
        fraction = F.regexp_extract(text, r"\.(\d+)", 1)
        shift = F.coalesce(
            F.regexp_extract(text, r"E(-?\d+)", 1).try_cast("int"), F.lit(0)
        )
        padded = F.concat(whole, fraction)
        leading = F.length(F.regexp_extract(padded, "^(0*)", 1))
        digits = F.regexp_replace(padded, "^0+|0+$", "")
        exponent = F.length(whole) + shift - leading - 1

        def written(d: Column, e: Column) -> Column:
            scientific = F.concat(
                F.substring(d, 1, 1),
                F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""),
                F.lit("e"),
                F.when(e < 0, "-").otherwise("+"),
                F.when(F.abs(e) < 10, F.lit("0")).otherwise(""),
                F.abs(e).cast("string"),
            )
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
            integral = F.rpad(d, e + 1, F.lit("0"))
            mixed = F.concat(
                F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)
            )
            plain = (
                F.when(e < 0, small).when(F.length(d) <= e + 1, integral).otherwise(mixed)
            )
            return F.when((e < -4) | (e >= 6), scientific).otherwise(plain)

        return F.when(digits == "", F.concat(sign, F.lit("0"))).otherwise(
            F.concat(sign, let(digits, lambda d: let(exponent, lambda e: written(d, e))))
        )

    return let(value.cast("string"), render)


def any_value_text(value: Column) -> Column:
    """Text of a tagged value; lists and key-value lists give the empty text."""
    return F.coalesce(
        value["stringValue"],
        value["intValue"],
        general_number(value["doubleValue"]),
        value["boolValue"].cast("string"),
        F.lit(""),
    )


def record_time(nanos: Column, arrival: Column) -> Column:
    """Instant of an all-digit nanosecond text, else the arrival time."""
    micros = F.call_function(
        "div", nanos.try_cast("decimal(20,0)"), F.lit(1000).cast("decimal(20,0)")
    )
    return F.coalesce(
        F.when(nanos.rlike(r"^[0-9]+\z"), F.timestamp_micros(micros)), arrival
    )


def _all(*tests: Column) -> Column:
    return reduce(Column.__and__, tests)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _is_object(value: Column, test: Callable[[Column], Column]) -> Column:
    """Absent, or an object that passes."""
    return let(
        value, lambda v: _absent(v) | (F.try_variant_get(v, "$", "struct<>").isNotNull() & test(v))
    )


def _is_scalar(value: Column, *kinds: str) -> Column:
    """Absent, or of one of the kinds; an object or a list is none of them."""

    def fits(kind: Column) -> Column:
        return reduce(Column.__or__, [kind.startswith(k) for k in kinds], kind == "VOID")

    return F.coalesce(let(F.schema_of_variant(value), fits), F.lit(True))


def _are_strings(value: Column, *names: str) -> Column:
    return _all(*[_is_scalar(_at(value, name), "STRING") for name in names])


def _is_list(value: Column, path: str, test: Callable[[Column], Column]) -> Column:
    """Absent, or a list whose elements all pass."""
    def fits(found: Column) -> Column:
        items = F.try_variant_get(found, "$", "array<variant>")
        # A value that is no list has no items.
        return _absent(found) | F.coalesce(F.forall(items, test), F.lit(False))

    return let(_at(value, path), fits)


def _any_value_fits(value: Column) -> Column:
    numbers = ("BIGINT", "DECIMAL", "DOUBLE")
    return _is_object(
        value,
        lambda v: _all(
            _is_scalar(_at(v, "stringValue"), "STRING"),
            # An integer comes as a text; a number is taken as well.
            _is_scalar(_at(v, "intValue"), "STRING", *numbers),
            _is_scalar(_at(v, "doubleValue"), *numbers),
            _is_scalar(_at(v, "boolValue"), "BOOLEAN"),
        ),
    )


def _attribute_fits(value: Column) -> Column:
    return _is_object(value, lambda v: _are_strings(v, "key") & _any_value_fits(_at(v, "value")))


def _record_fits(value: Column) -> Column:
    return _is_object(
        value,
        lambda v: _all(
            _are_strings(v, "timeUnixNano", "severityText", "traceId", "spanId"),
            _is_scalar(_at(v, "severityNumber"), "BIGINT"),
            _any_value_fits(_at(v, "body")),
            _is_list(v, "attributes", _attribute_fits),
        ),
    )


def _scope_fits(value: Column) -> Column:
    return _is_object(
        value,
        lambda v: _is_object(_at(v, "scope"), lambda s: _are_strings(s, "name", "version"))
        & _is_list(v, "logRecords", _record_fits),
    )


def _resource_fits(value: Column) -> Column:
    return _is_object(
        value,
        lambda v: _is_object(_at(v, "resource"), lambda r: _is_list(r, "attributes", _attribute_fits))
        & _is_list(v, "scopeLogs", _scope_fits),
    )


# What a value of the right type begins with, by the names of the fields.  A whole number that
# might be too long for a BIGINT counts as doubtful.
LEADS = {
    '"': "timeUnixNano severityText traceId spanId key stringValue name version",
    r'["0-9-]': "intValue",
    "[0-9-]": "doubleValue",
    "[tf]": "boolValue",
    r"-?[0-9]{1,18}\s*[,}\]]": "severityNumber",
    r"\{": "resource scope body value",
    r"\[\s*[{\]]": "resourceLogs scopeLogs logRecords attributes",
}
# Texts in which a field or a list element might have a wrong type: a field that begins with
# something else, something other than a field name or an object after an object, and names
# that may be written with escapes.
# The branches part at their first character, so most positions are left after one comparison.
_FIELDS = "|".join(rf'(?:{names.replace(" ", "|")})"\s*+:\s*+(?!{lead})' for lead, names in LEADS.items())
DOUBTFUL = rf'"(?:{_FIELDS})' + r'|\}\s*+,\s*+(?:[^{"\s]|"[^"\\]*+(?:\\|"\s*+[^:\s]))|\\u'


def fits_request(payload: Column) -> Column:
    """Every field that is there has the type it should have.

    A value's first characters tell its type, so one pattern finds the texts in which a wrong
    type is possible; only these are parsed and looked into.  A payload too large for a
    VARIANT is not looked into.
    """
    return F.coalesce(~payload.rlike(DOUBTFUL) | _all_types_fit(payload), F.lit(True))


def _all_types_fit(payload: Column) -> Column:
    told = let(F.try_parse_json(payload), lambda v: _is_list(v, "resourceLogs", _resource_fits))
    return F.coalesce(told, F.lit(True))


def decode_request(payload: Column) -> Column:
    """Request of a payload that is one JSON object; NULL when it has to be refused.

    A field of a wrong type refuses the whole request.  ``null`` is an empty request.
    """
    seal = F.xxhash64(payload)
    sealing = F.concat(F.lit('{"seal":'), seal.cast("string"), F.lit("}"))

    def unseal(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        return F.when(
            (F.get(found, F.lit(1))["seal"] == seal) & first.isNotNull(), first
        )

    opens = F.ltrim(payload, F.lit(JSON_SPACE)).startswith("{")
    empty = F.btrim(payload, F.lit(JSON_SPACE)) == "null"
    decoded = let(F.from_json(sealed(payload, sealing), REQUEST, JSON_OPTIONS), unseal)
    return F.when(opens & fits_request(payload), decoded).when(empty, F.from_json(F.lit("{}"), REQUEST_FIELDS))


def rejected_requests(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Requests that cannot be decoded and are refused whole."""
    known = with_once(requests, "_refused", decode_request(F.col(payload)).isNull())
    return known.where("_refused").drop("_refused")


def resource_tags(attributes: Column) -> Column:
    """Tags from the promoted attributes; of a repeated one the last counts."""
    wanted = F.filter(
        F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: a["key"].isin(*PROMOTED)
    )
    names = F.create_map(*(F.lit(text) for pair in PROMOTED.items() for text in pair))

    def to_map(found: Column) -> Column:
        last = F.filter(
            found,
            lambda a, i: ~F.exists(
                F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == a["key"]
            ),
        )
        return F.map_from_entries(
            F.transform(
                last, lambda a: F.struct(F.element_at(names, a["key"]), any_value_text(a["value"]))
            )
        )

    return let(wanted, to_map)


def record_tags(record: Column, scope: Column, inherited: Column) -> Column:
    """Tags of a log record: severity, scope and ids, over its resource's tags."""
    named = {
        "otel_scope": scope["name"],
        "trace_id": record["traceId"],
        "span_id": record["spanId"],
    }
    own = F.map_from_arrays(
        F.array(*(F.lit(name) for name in ("otel_severity", *named))),
        F.array(
            severity(record["severityText"], record["severityNumber"]),
            *(blank_to_null(value) for value in named.values()),
        ),
    )
    return F.map_concat(F.map_filter(own, lambda _, value: value.isNotNull()), inherited)


def flatten_requests(requests: DataFrame) -> DataFrame:
    """Log records of requests given as ``seq, ts, payload``, one row each.

    The result is RAW_LOG, with the request's ``seq``, and ``place``, the record's
    position in its request.  ``ts`` is the arrival time.  With ``file_path``, ``seq`` counts
    inside a file.
    """
    decoded = with_once(requests, "request", decode_request(F.col("payload")))
    origin = [F.col("file_path").alias("origin")] if "file_path" in requests.columns else []

    def of_scope(scope_logs: Column, tags: Column) -> Column:
        return F.transform(
            scope_logs["logRecords"],
            lambda record: F.struct(
                tags.alias("tags"),
                scope_logs["scope"].alias("scope"),
                record.alias("record"),
            ),
        )

    def of_resource(logs: Column) -> Column:
        def with_tags(tags: Column) -> Column:
            scopes = F.transform(logs["scopeLogs"], lambda s: of_scope(s, tags))
            return F.flatten(F.filter(scopes, lambda s: s.isNotNull()))

        return let(resource_tags(logs["resource"]["attributes"]), with_tags)

    groups = F.transform(F.col("request.resourceLogs"), of_resource)
    records = F.flatten(F.filter(groups, lambda g: g.isNotNull()))
    rows = decoded.select("seq", "ts", *origin, F.posexplode(records).alias("place", "r"))
    record = F.col("r.record")
    return rows.select(
        F.lit("otel").alias("source"),
        *(["origin"] if origin else []),
        "seq",
        record_time(record["timeUnixNano"], F.col("ts")).alias("ts"),
        any_value_text(record["body"]).alias("line"),
        record_tags(record, F.col("r.scope"), F.col("r.tags")).alias("tags"),
        "place",
    )


def otlp_source(
    spark: SparkSession, paths: str | list[str], streaming: bool = False
) -> DataFrame:
    """RAW_LOG of files that hold one request per line."""
    requests = read_text_files(spark, paths, streaming, numbered=False).withColumnRenamed("line", "payload")
    records = raw_log(flatten_requests(requests))
    if streaming:
        # A request takes more bytes than it has records, as a line does than it is one.
        return number_stream_rows(records, "origin")
    return records.withColumn("seq", F.monotonically_increasing_id())
