"""Multi-line recombination: which lines belong to one record.

A line joins the record of the line before it when a continuation rule says so.
The rule looks at two neighbouring lines only, so records are the islands between
the lines that start one.

``recombine`` shuffles the lines once, by (stream, bucket of ``seq``).  A stream
that holds a third of all lines is therefore spread over many tasks.  Fragments
are built inside the buckets; what crosses a bucket border is the short run of
lines at a bucket's head, and only those move.  Which buckets join is decided on a few
flags for each: consecutive buckets form groups, a group shrinks to a row of the same
flags, and only those rows of a stream meet.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.once import with_once
from faultline.functions.text import trim_blank_left
from faultline.operators.scan import BUCKET_ROWS, bucket_of

# Consecutive buckets whose borders are decided in one task.
GROUP_BUCKETS = 1 << 12


class Rule(NamedTuple):
    """When a line continues the record of the line before it.

    It does when ``alone`` holds for it, or when ``closing`` holds for it and
    ``opening`` for the line before.  Each looks at one line, so a stream can work
    them out row by row and needs to remember one flag.
    """

    alone: Callable[[Column], Column]
    closing: Callable[[Column], Column] = lambda line: F.lit(False)
    opening: Callable[[Column], Column] = lambda line: F.lit(False)

    def flags(self, line: Column, ts: Column) -> Column:
        """What the rule and the idle time need to know of a line."""
        return F.struct(
            self.alone(line).alias("alone"),
            self.closing(line).alias("closing"),
            self.opening(line).alias("opening"),
            F.unix_micros(ts).alias("at"),
        )

    def __call__(self, prev: Column, line: Column) -> Column:
        return self.alone(line) | (self.closing(line) & self.opening(prev))


def _indented(line: Column) -> Column:
    return line.startswith(" ") | line.startswith("\t")


def _has_detail(line: Column) -> Column:
    return F.contains(line, F.lit(": "))


def _java(line: Column) -> Column:
    body = trim_blank_left(line)
    return (
        body.startswith("at ")
        | body.startswith("... ")
        | body.startswith("Caused by:")
        | body.startswith("Suppressed:")
    )


def _go(line: Column) -> Column:
    dot = F.instr(line, F.lit("."))
    call = (dot > 1) & F.contains(F.substr(line, dot), F.lit("("))
    return (
        (line == "")
        | _indented(line)
        | line.startswith("goroutine ")
        | line.startswith("exit status ")
        | call
    )


def _node(line: Column) -> Column:
    return line.startswith("    at ") | line.startswith("\tat ")


def _ruby(line: Column) -> Column:
    return trim_blank_left(line).startswith("from ")


RULES: dict[str, Rule] = {
    # Indented lines, and the "Type: text" line after an indented one.
    "python": Rule(_indented, _has_detail, _indented),
    # Frames, elided frames, causes and suppressed exceptions.
    "java": Rule(_java),
    # Blank, indented, goroutine and exit lines, and "pkg.Func(" shapes.
    "go": Rule(_go),
    "node": Rule(_node),
    "ruby": Rule(_ruby),
    # Any of them; a blank line always continues.
    "universal": Rule(
        lambda line: _go(line) | _java(line) | _node(line) | _ruby(line),
        _has_detail,
        _indented,
    ),
}


def stream_key(source: Column, tags: Column) -> Column:
    """Name of the logical stream a record belongs to."""

    def tag(name: str) -> Column:
        return F.nullif(F.try_element_at(tags, F.lit(name)), F.lit(""))

    pod, container = tag("k8s_pod"), tag("container_name")
    return F.coalesce(
        F.concat(F.lit("k8s:"), pod, F.lit("/"), F.coalesce(container, F.lit(""))),
        F.concat(F.lit("docker:"), container),
        F.concat(F.lit("journald:"), tag("systemd_unit")),
        F.concat(F.lit("file:"), tag("file_path")),
        source,
        F.lit(""),
    )


def with_stream_key(raw: DataFrame) -> DataFrame:
    return raw.withColumn("stream_key", stream_key(F.col("source"), F.col("tags")))


def joins_previous(prev: Column, line: Column, idle_ms: int | None) -> Column:
    """True when a line continues the record its predecessor is in; both are given by their flags."""
    joined = line["alone"] | (line["closing"] & prev["opening"])
    if idle_ms is not None:
        joined = joined & ~F.coalesce(line["at"] - prev["at"] >= idle_ms * 1000, F.lit(False))
    return F.coalesce(prev.isNotNull() & joined, F.lit(False))


def _across_buckets(
    borders: DataFrame, keys: list[str], idle_ms: int | None
) -> DataFrame:
    """``_joined`` and ``_home`` of each bucket, in two levels.

    ``borders`` has the flags of a bucket's first and last line, ``_opening`` and ``_end``, its
    ``_group``, and whether a record starts inside it, ``_splits``.  A bucket is joined when its
    first line continues the bucket before; its home is the last earlier bucket in which a
    record starts.
    """
    inside = Window.partitionBy(*keys, "_group").orderBy("_bucket")
    opens = F.when(
        F.col("_splits") | (F.col("_before").isNotNull() & ~F.col("_joined")), F.col("_bucket")
    )
    near = (
        borders.withColumn("_before", F.lag("_end").over(inside))
        .withColumn("_joined", joins_previous(F.col("_before"), F.col("_opening"), idle_ms))
        .withColumn("_opens", opens)
        .withColumn(
            "_home", F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
        )
    )
    # The first bucket of a group learns from the groups before whether it is joined.
    across = Window.partitionBy(*keys).orderBy("_group")
    starts = F.when(~F.col("_first_joined"), F.col("_first"))
    groups = (
        near.groupBy(*keys, "_group")
        .agg(
            F.min("_bucket").alias("_first"),
            F.min_by("_opening", "_bucket").alias("_first_line"),
            F.max_by("_end", "_bucket").alias("_last_line"),
            F.max("_opens").alias("_last_opens"),
        )
        .withColumn(
            "_first_joined",
            joins_previous(F.lag("_last_line").over(across), F.col("_first_line"), idle_ms),
        )
        .select(
            *keys,
            "_group",
            "_first",
            "_first_joined",
            F.max(F.greatest("_last_opens", starts))
            .over(across.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_home_before"),
        )
    )
    is_first = F.col("_bucket") == F.col("_first")
    return near.join(groups, [*keys, "_group"]).select(
        *keys,
        "_bucket",
        F.when(is_first, F.col("_first_joined")).otherwise(F.col("_joined")).alias("_joined"),
        F.greatest("_home", F.when(~is_first, starts), "_home_before").alias("_home"),
    )


def recombine(
    lines: DataFrame,
    rule: str | Rule = "universal",
    idle_ms: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    group_buckets: int = GROUP_BUCKETS,
) -> DataFrame:
    """Join the lines of each stream into records.

    ``lines`` has ``stream_key, seq, ts, line`` and any further columns; ``seq``
    is unique within a stream or, with a column ``origin``, within an origin of it: a record
    then lies in one origin.  The result has one row per record: the columns of
    the record's first line, with ``line`` the whole text and ``n_lines`` added.
    With ``idle_ms`` a pause that long also ends a record.
    """
    continues = RULES[rule] if isinstance(rule, str) else rule
    keys = ["stream_key", *(["origin"] if "origin" in lines.columns else [])]
    carried = [c for c in lines.columns if c not in (*keys, "line")]
    rows = lines.withColumns(
        {
            **{key: F.coalesce(key, F.lit("")) for key in keys},
            "line": F.rtrim(F.coalesce("line", F.lit("")), F.lit("\n")),
            "_bucket": bucket_of(F.col("seq"), bucket_rows),
        }
    )
    # Dealt out before a rule looks at them: all uses, of several rules too, read one shuffle.
    rows = rows.repartition(*keys, "_bucket")

    # Fragments: islands inside one bucket.  The first line of a bucket opens
    # fragment 0 without a verdict; its predecessor is in another bucket.
    inside = Window.partitionBy(*keys, "_bucket").orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        rows.withColumn("_flags", continues.flags(F.col("line"), F.col("ts")))
        .withColumn("_prev", F.lag("_flags").over(inside))
        .withColumn(
            "_starts",
            F.col("_prev").isNotNull()
            & ~joins_previous(F.col("_prev"), F.col("_flags"), idle_ms),
        )
        .withColumn("_fragment", F.sum(F.col("_starts").cast("int")).over(upto))
    )
    first = F.min_by(F.struct(*carried), "seq").alias("_first")
    fragments = (
        cut.where("_fragment > 0")
        .groupBy(*keys, "_bucket", "_fragment")
        .agg(
            F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY seq)").alias("_text"),
            F.count("*").alias("n_lines"),
            first,
        )
    )

    # One row per bucket: its fragment 0, the flags of its first and last line.  Both uses
    # below read one shuffle of these rows; the texts take part in the last join only.
    head_text = r"listagg(CASE WHEN _fragment = 0 THEN line END, '\n') WITHIN GROUP (ORDER BY seq)"
    edges = cut.groupBy(*keys, "_bucket").agg(
        F.expr(head_text).alias("_text"),
        F.count_if(F.col("_fragment") == 0).alias("n_lines"),
        first,
        F.min_by("_flags", "seq").alias("_opening"),
        F.max_by("_flags", "seq").alias("_end"),
        F.max("_fragment").alias("_last_fragment"),
    )
    edge = F.struct(
        F.struct("_text", "n_lines", "_first").alias("_head"), "_opening", "_end", "_last_fragment"
    )
    buckets = (
        with_once(edges, "_edge", edge)
        .select(
            *keys, "_bucket", bucket_of(F.col("_bucket"), group_buckets).alias("_group"), "_edge"
        )
        .repartition(*keys, "_group")
    )
    borders = buckets.select(
        *keys,
        "_group",
        "_bucket",
        "_edge._opening",
        "_edge._end",
        (F.col("_edge._last_fragment") > 0).alias("_splits"),
    )
    placed = buckets.select(*keys, "_bucket", "_edge._head", "_edge._last_fragment").join(
        _across_buckets(borders, keys, idle_ms), [*keys, "_bucket"]
    )

    # A bucket's head either opens a record there, or belongs to the record still open
    # in an earlier bucket, its home.  One row per home: its own head, its last
    # fragment, and the tail that other buckets' heads add to that.
    stays = F.struct(
        F.col("_bucket").alias("_bucket"),
        F.col("_last_fragment").alias("_last_fragment"),
        F.when(~F.col("_joined"), F.col("_head")).alias("_head"),
        F.lit(None).cast("bigint").alias("_from"),
        F.lit(None).cast("string").alias("_text"),
        F.lit(None).cast("bigint").alias("_lines"),
    )
    moves = F.struct(
        F.col("_home").alias("_bucket"),
        F.lit(None).cast("bigint").alias("_last_fragment"),
        F.lit(None).cast(placed.schema["_head"].dataType).alias("_head"),
        F.col("_bucket").alias("_from"),
        F.col("_head._text").alias("_text"),
        F.col("_head.n_lines").alias("_lines"),
    )
    roles = (
        F.when(~F.col("_joined"), F.array(stays))
        .when(F.col("_last_fragment") > 0, F.array(stays, moves))
        .otherwise(F.array(moves))
    )
    homes = (
        placed.select(*keys, F.explode(roles).alias("_role"))
        .select(*keys, "_role.*")
        .groupBy(*keys, "_bucket")
        .agg(
            F.expr(r"listagg(_text, '\n') WITHIN GROUP (ORDER BY _from)").alias("_tail"),
            F.sum("_lines").alias("_tail_lines"),
            F.max("_last_fragment").alias("_last_fragment"),
            F.max_by("_head", F.col("_head").isNotNull()).alias("_head"),
        )
    )

    grows = F.col("_fragment") == F.col("_last_fragment")
    records = [
        # Homes are joined by (stream, bucket), as the fragments are partitioned.
        fragments.where("_fragment > 0").join(
            homes.drop("_head"), [*keys, "_bucket"], "left"
        ),
        homes.where(F.col("_head").isNotNull()).select(
            *keys,
            F.lit(0).cast("bigint").alias("_fragment"),
            "_last_fragment",
            "_tail",
            "_tail_lines",
            "_head.*",
        ),
    ]
    finished = [
        part.select(
            *keys,
            *(F.col(f"_first.{c}").alias(c) for c in carried),
            F.concat_ws("\n", "_text", F.when(grows, F.col("_tail"))).alias("line"),
            (
                F.col("n_lines")
                + F.when(grows, F.coalesce("_tail_lines", F.lit(0))).otherwise(0)
            ).alias("n_lines"),
        )
        for part in records
    ]
    return finished[0].unionByName(finished[1])
