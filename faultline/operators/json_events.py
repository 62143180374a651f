"""Events from structured JSON log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.patterns import RFC3339
from faultline.functions.text import let, trim_space
from faultline.functions.variants import (
    array_field,
    first_text,
    is_object,
    number_field,
    object_field,
    parse_object,
    text_fields,
)
from faultline.schema import EVENT, EXCEPTION, FRAME

# Spellings of each level.
LEVELS = {
    "fatal": ("fatal", "critical", "crit"),
    "error": ("error", "err"),
    "warning": ("warn", "warning"),
    "info": ("info", "notice"),
    "debug": ("debug",),
}
ERROR_LEVELS = ("fatal", "error")

# What every object at an error level holds: letters of a level, or an escape.
ERROR_LEVEL_HINT = r"(?iu)err|fatal|crit|\\u"

# Field names tried in turn.
LEVEL_KEYS = ("level", "severity")
MESSAGE_KEYS = ("message", "msg", "log")
TIME_KEYS = ("timestamp", "ts", "time")
ENVIRONMENT_KEYS = ("environment", "env")
RELEASE_KEYS = ("release", "version", "app_version")
SERVER_KEYS = ("server_name", "hostname", "host")
PLATFORM_KEYS = ("platform", "language")
LOGGER_KEYS = ("logger", "logger_name")
TYPE_KEYS = ("type", "class")
VALUE_KEYS = ("value", "message")
FLAT_ERROR_KEYS = ("error", "err")
FILE_KEYS = ("filename", "file")
FUNCTION_KEYS = ("function", "func", "method")
CONTEXT_KEYS = ("context_line", "line", "code")

RECORD_KEYS = (
    *LEVEL_KEYS,
    *MESSAGE_KEYS,
    *TIME_KEYS,
    *ENVIRONMENT_KEYS,
    *RELEASE_KEYS,
    *SERVER_KEYS,
    *PLATFORM_KEYS,
    *LOGGER_KEYS,
    *FLAT_ERROR_KEYS,
)

# Logger name parts that reveal a platform.
PLATFORM_LOGGERS = (("python", "django|fastapi|flask"), ("node", "express|node"))


def normalise_level(level: Column) -> Column:
    """Canonical level name; unknown ones are lower-cased as they are."""
    known = F.create_map(
        *(F.lit(text) for name, words in LEVELS.items() for word in words for text in (word, name))
    )
    return F.coalesce(F.try_element_at(known, F.lower(trim_space(level))), F.lower(level))


def is_error_level(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)


def parse_rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text, NULL for any other spelling."""
    return F.when(
        text.rlike(RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit(".")))
    )


def record_texts(record: Column) -> Column:
    """The string fields of a record that mean something here."""
    return text_fields(record, RECORD_KEYS)


def infer_platform(texts: Column) -> Column:
    def guess(logger: Column) -> Column:
        platform = F.lit("unknown")
        for name, parts in reversed(PLATFORM_LOGGERS):
            platform = F.when(logger.rlike(parts), name).otherwise(platform)
        return platform

    named = first_text(texts, *PLATFORM_KEYS)
    return F.coalesce(named, let(first_text(texts, *LOGGER_KEYS), guess))


def json_frames(stacktrace: Column) -> Column:
    """Frames of a ``stacktrace`` object; NULL when it has no frame list."""

    def frame(f: Column) -> Column:
        def read(texts: Column) -> Column:
            line = number_field(f, "lineno").try_cast("bigint")
            return F.struct(
                F.coalesce(first_text(texts, *FILE_KEYS), F.lit("")),
                F.coalesce(first_text(texts, *FUNCTION_KEYS), F.lit("")),
                F.nullif(line, F.lit(0).cast("bigint")),
                first_text(texts, *CONTEXT_KEYS),
            ).cast(FRAME)

        return let(text_fields(f, (*FILE_KEYS, *FUNCTION_KEYS, *CONTEXT_KEYS)), read)

    return F.transform(F.filter(array_field(stacktrace, "frames"), is_object), frame)


def json_exception(record: Column, texts: Column) -> Column:
    """Nested ``exception`` object first, then a flat error string."""

    def nested(exc: Column) -> Column:
        def named(own: Column) -> Column:
            trace = let(
                json_frames(object_field(exc, "stacktrace")),
                lambda frames: F.when(frames.isNotNull(), F.struct(frames)),
            )
            kind, value = first_text(own, *TYPE_KEYS), first_text(own, *VALUE_KEYS)
            return F.when(
                F.size(own) > 0,
                F.struct(F.coalesce(kind, F.lit("")), F.coalesce(value, F.lit("")), trace).cast(
                    EXCEPTION
                ),
            )

        return F.when(exc.isNotNull(), let(text_fields(exc, (*TYPE_KEYS, *VALUE_KEYS)), named))

    def flat(text: Column) -> Column:
        no_trace = F.lit(None).cast(EXCEPTION["stacktrace"].dataType)
        return F.when(
            text.isNotNull(), F.struct(F.lit("Error"), text, no_trace).cast(EXCEPTION)
        )

    return F.coalesce(
        let(object_field(record, "exception"), nested),
        let(first_text(texts, *FLAT_ERROR_KEYS), flat),
    )


def json_level(texts: Column) -> Column:
    return normalise_level(first_text(texts, *LEVEL_KEYS))


def json_event(line: Column) -> Column:
    """EVENT of a line that is one JSON object at error level, else NULL."""

    def event(record: Column) -> Column:
        def with_texts(texts: Column) -> Column:
            def at_level(level: Column) -> Column:
                return F.when(
                    is_error_level(level),
                    F.struct(
                        F.lit("json"),
                        infer_platform(texts),
                        level,
                        first_text(texts, *MESSAGE_KEYS),
                        first_text(texts, *ENVIRONMENT_KEYS),
                        first_text(texts, *RELEASE_KEYS),
                        first_text(texts, *SERVER_KEYS),
                        let(first_text(texts, *TIME_KEYS), parse_rfc3339),
                        json_exception(record, texts),
                        F.lit(None),
                    ).cast(EVENT),
                )

            return let(json_level(texts), at_level)

        return F.when(record.isNotNull(), let(record_texts(record), with_texts))

    def trimmed(text: Column) -> Column:
        likely = text.startswith("{") & text.rlike(ERROR_LEVEL_HINT)
        return F.when(likely, let(parse_object(text), event))

    return let(trim_space(line), trimmed)
