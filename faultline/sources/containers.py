"""Container logs that arrive as chunks of bytes, cut anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.scan import BUCKET_ROWS, with_totals_before
from faultline.sources.text import raw_log


def container_name(names: Column) -> Column:
    """First name without one leading slash; ``unknown`` when there is none."""
    first = F.try_element_at(names, F.lit(1))
    return F.coalesce(F.regexp_replace(first, "^/", ""), F.lit("unknown"))


def keeps_container(name: Column, excluded: Sequence[str] = ()) -> Column:
    return ~name.isin(*excluded) if excluded else F.lit(True)


def started_containers(events: DataFrame) -> DataFrame:
    """Containers running after a series of start and die events.

    ``events`` has ``container_id, seq, status, name``.  A repeated start does not
    add a second reader; a die ends it.
    """
    known = events.where(F.col("status").isin("start", "die"))
    last = known.groupBy("container_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("name", F.when(F.col("status") == "start", F.col("seq"))).alias("name"),
    )
    return last.where(F.col("status") == "start").drop("status")


def assemble_lines(
    chunks: DataFrame,
    container: str = "container_id",
    order: str = "chunk_no",
    payload: str = "payload",
    ts: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Lines of each container, as ``container, line_no, line``.

    With ``ts``, the arrival time of a chunk, also the time of the chunk that ends a
    line.

    Payloads run on from chunk to chunk; only ``\\n`` ends a line, and text after
    the last one is not a line yet.  Lines inside one chunk come out where they are;
    the first and last piece of each chunk are all that is shuffled to be joined.
    """
    pieces = F.split(payload, "\n", -1)
    cut = chunks.select(
        container,
        order,
        pieces.alias("_pieces"),
        (F.size(pieces) - 1).cast("bigint").alias("_ends"),
        *([F.col(ts).alias("ts")] if ts else []),
    )
    time = ["ts"] if ts else []
    numbered = with_totals_before(
        cut, [container], order, sums={"_line": F.col("_ends")}, bucket_rows=bucket_rows
    )
    inner = numbered.select(
        container,
        "_line",
        *time,
        F.posexplode(F.slice("_pieces", 2, F.greatest(F.col("_ends") - 1, F.lit(0)).cast("int"))),
    ).select(
        container,
        (F.col("_line") + F.col("pos") + 1).alias("line_no"),
        F.col("col").alias("line"),
        *time,
    )
    first = F.array(
        F.struct(
            F.col("_line").alias("line_no"),
            (F.col("_ends") > 0).alias("ended"),
            F.get("_pieces", F.lit(0)).alias("piece"),
        )
    )
    last = F.array(
        F.struct(
            (F.col("_line") + F.col("_ends")).alias("line_no"),
            F.lit(False).alias("ended"),
            F.element_at("_pieces", -1).alias("piece"),
        )
    )
    edges = numbered.select(
        container,
        order,
        *time,
        F.explode(F.when(F.col("_ends") > 0, F.concat(first, last)).otherwise(first)).alias("_edge"),
    ).select(container, order, *time, "_edge.*")
    joined = (
        edges.groupBy(container, "line_no")
        .agg(
            F.expr(f"listagg(piece, '') WITHIN GROUP (ORDER BY {order})").alias("line"),
            F.bool_or("ended").alias("_ended"),
            *(F.max(F.when(F.col("ended"), F.col(t))).alias(t) for t in time),
        )
        .where("_ended")
        .drop("_ended")
    )
    whole = joined.withColumn("line", F.coalesce("line", F.lit("")))
    return inner.unionByName(whole.select(inner.columns))


def container_source(chunks: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """RAW_LOG of chunks given as ``container_id, names, chunk_no, payload``.

    The name is a property of the container, so it is the same on all its chunks.
    With the chunks' arrival ``ts``, a line's time is that of the chunk that ends it;
    without it the time is NULL, and no idle gap can split a record.
    """
    named = chunks.withColumn("container_name", container_name(F.col("names"))).where(
        keeps_container(F.col("container_name"), excluded)
    )
    keyed = named.withColumn("_container", F.struct("container_id", "container_name"))
    timed = "ts" in chunks.columns
    lines = assemble_lines(keyed, "_container", ts="ts" if timed else None)
    return raw_log(
        lines.select(
            F.lit("docker").alias("source"),
            F.col("_container.container_id").cast("string").alias("origin"),
            F.col("line_no").alias("seq"),
            (F.col("ts") if timed else F.lit(None)).alias("ts"),
            "line",
            F.create_map(F.lit("container_name"), F.col("_container.container_name")).alias("tags"),
        )
    )
