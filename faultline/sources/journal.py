"""Journal entries exported as one JSON object per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.once import with_once
from faultline.functions.variants import parse_object, string_field
from faultline.sources.text import raw_log, read_text_files

# Units of the system itself, never read.
EXCLUDED_UNIT_PREFIXES = ("systemd-", "dbus.", "polkit.")


def realtime(micros: Column) -> Column:
    """Instant of an all-digit microsecond text, else NULL."""
    return F.when(
        micros.rlike(r"^[0-9]+\z"), F.timestamp_micros(micros.try_cast("bigint"))
    )


def keeps_unit(unit: Column, units: Sequence[str] = ()) -> Column:
    """Not a system unit, and one of ``units`` when any are named."""
    kept = F.lit(True)
    for prefix in EXCLUDED_UNIT_PREFIXES:
        kept = kept & ~unit.startswith(prefix)
    return kept & unit.isin(*units) if units else kept


def decode_journal(entries: DataFrame, units: Sequence[str] = ()) -> DataFrame:
    """RAW_LOG of entries given as ``seq, ts, line``; ``ts`` is the arrival time.

    With ``file_path``, ``seq`` counts inside a file.

    Entries that are not one JSON object, or whose message is not a non-empty
    string, are left out; ``rejected_entries`` gives the former.
    """
    origin = [F.col("file_path").alias("origin")] if "file_path" in entries.columns else []
    parsed = with_once(entries, "entry", parse_object(F.col("line"))).where(
        F.col("entry").isNotNull()
    )
    entry = F.col("entry")
    empty = F.lit("")
    unit = F.coalesce(string_field(entry, "_SYSTEMD_UNIT"), string_field(entry, "UNIT"), empty)
    read = F.struct(
        unit.alias("unit"),
        string_field(entry, "MESSAGE").alias("line"),
        F.coalesce(string_field(entry, "_HOSTNAME"), empty).alias("hostname"),
        F.coalesce(string_field(entry, "PRIORITY"), empty).alias("priority"),
        string_field(entry, "__REALTIME_TIMESTAMP").alias("micros"),
    )
    fields = with_once(parsed, "fields", read).select("seq", "ts", *origin, "fields.*")
    kept = fields.where(keeps_unit(F.col("unit"), units) & (F.col("line") != ""))
    return raw_log(
        kept.select(
            F.lit("journald").alias("source"),
            *(["origin"] if origin else []),
            "seq",
            F.coalesce(realtime(F.col("micros")), F.col("ts")).alias("ts"),
            "line",
            F.create_map(
                F.lit("systemd_unit"),
                F.col("unit"),
                F.lit("hostname"),
                F.col("hostname"),
                F.lit("priority"),
                F.col("priority"),
            ).alias("tags"),
        )
    )


def rejected_entries(entries: DataFrame, line: str = "line") -> DataFrame:
    """Entries that cannot be read: not exactly one JSON object, or too large for a VARIANT.

    A NULL line is one too.  Entries that are read but have no message are none.
    """
    known = with_once(entries, "_refused", parse_object(F.col(line)).isNull())
    return known.where("_refused").drop("_refused")


def journal_source(
    spark: SparkSession,
    paths: str | list[str],
    units: Sequence[str] = (),
    streaming: bool = False,
) -> DataFrame:
    return decode_journal(read_text_files(spark, paths, streaming), units)
