"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())

# One record of any log source.  ``seq`` is the arrival order within a stream, or within an
# ``origin`` where that column is there too.
RAW_LOG = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line", T.StringType()),
        T.StructField("tags", TAGS),
    ]
)

# The file, container or the like that a record was read from, as every reader of this package
# tells; several origins may share the name of a stream.
ORIGIN = T.StructField("origin", T.StringType())

FRAME = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("lineno", T.LongType()),
        T.StructField("context_line", T.StringType()),
    ]
)

EXCEPTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField(
            "stacktrace", T.StructType([T.StructField("frames", T.ArrayType(FRAME))])
        ),
    ]
)

# What one extraction layer yields for a log record, NULL when it finds nothing.
EVENT = T.StructType(
    [
        T.StructField("parser", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("release", T.StringType()),
        T.StructField("server_name", T.StringType()),
        T.StructField("own_ts", T.TimestampType()),
        T.StructField("exception", EXCEPTION),
        T.StructField("tags", TAGS),
    ]
)

# Columns of the delivered error event, in wire order.
ENVELOPE_COLUMNS = (
    "event_id",
    "timestamp",
    "project_id",
    "platform",
    "level",
    "environment",
    "release",
    "server_name",
    "message",
    "exception",
    "tags",
)

# Function-level piece of a source file.
SOURCE_CHUNK = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)
