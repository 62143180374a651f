"""Exact duplicates, with frequent texts taken out before the shuffle.

A Misra-Gries summary over the digests names the few texts that may fill a large part of the
table.  Exact counts decide which of them do, and those winners are broadcast: their
copies are settled where they are read.  Only the other digests are shuffled, so no group in
that shuffle is larger than the summary's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import ascii_lower
from faultline.session import materialise

#: Summaries are merged in this many groups of partitions before the last merge.
MERGERS = 64


def digests(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, digest): SHA-256 of every whole text with A-Z lower-cased, null as empty."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest")
    )


def frequent_keys(rows: DataFrame, key: str, counters: int) -> DataFrame:
    """At most ``counters`` values of the BIGINT column ``key``, every frequent one among them.

    The summaries of approx_top_k follow Misra and Gries: counters that all shrink
    when they run out.  A value is missing only if its share is below about 7 / counters.
    """
    return (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger"))
        .agg(F.expr(f"approx_top_k_accumulate({key}, {counters})").alias("_s"))
        .groupBy(F.lit("all"))  # not a global aggregate: an empty table has nothing to combine
        .agg(F.expr(f"approx_top_k_combine(_s, {counters})").alias("_s"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(_s, {counters})")).alias("_k"))
        .select(F.col("_k.item").alias(key))
        .filter(F.col(key).isNotNull())
    )


def exact_dedup(docs: DataFrame, counters: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal
    texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and
    of rows that repeat the largest doc_id exactly one is ``kept``.  Other columns
    are ignored; an empty table gives an empty one.  ``counters`` bounds what is broadcast.
    """
    rows = materialise(digests(docs).withColumn("_key", F.xxhash64("digest")))
    group = (F.count("*").alias("_n"), F.max(F.struct("doc_id", "_row")).alias("_top"))
    winners = materialise(
        rows.join(F.broadcast(frequent_keys(rows, "_key", counters)), "_key", "left_semi")
        .groupBy("digest")
        .agg(*group)
        .filter("_n > 1")
    )
    marked = rows.join(F.broadcast(winners), "digest", "left")
    per_text = Window.partitionBy("digest")
    rest = marked.filter("_n is null").select(
        "_row",
        "doc_id",
        "digest",
        F.count("*").over(per_text).alias("_n"),
        F.max(F.struct("doc_id", "_row")).over(per_text).alias("_top"),
    )
    return (
        marked.filter("_n is not null")
        .select(*rest.columns)
        .union(rest)
        .select(
            "doc_id",
            F.col("_top.doc_id").alias("keep_id"),
            F.col("_n").alias("group_size"),
            (F.col("_row") == F.col("_top._row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
