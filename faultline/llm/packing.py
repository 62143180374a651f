"""Best-fit packing of documents into bins, with documents that may not share one.

Documents are dealt to shards by hash; in a shard the longest come first and each goes to the
bin that it fills most among those it may enter.  Bins lie in the order of what they have left.
A bin carries two bitmaps, the sources and the duplicate clusters it holds; the search
begins at the first bin with room enough and goes from successor to successor until the bitmaps agree.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACE, ascii_lower
from faultline.session import materialise

#: Words of a bin.
CAPACITY = 2048
#: Pieces of a shard, about.
SHARD_PIECES = 4096


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece: best fit in the given order; the older bin among equals.

    A bin takes one piece of a source and one of a cluster; -1 is no source or no cluster.
    """
    bins, offsets = [], []
    by_room: list[tuple[int, int]] = []  # (room left, bin)
    holds: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    # A bin that no piece fits into any more, whatever its bitmaps, leaves the search.
    least = min(sizes, default=0)
    # Only what is there twice can meet in a bin.
    many_sources, many_clusters = Counter(sources), Counter(clusters)
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << source if source >= 0 and many_sources[source] > 1 else 0
        c = 1 << cluster if cluster >= 0 and many_clusters[cluster] > 1 else 0
        at = bisect_left(by_room, (size, -1))
        while at < len(by_room):
            held = holds[by_room[at][1]]
            if not (held[0] & s or held[1] & c):
                break
            at += 1
        if at < len(by_room):
            room, to = by_room.pop(at)
            holds[to] = (holds[to][0] | s, holds[to][1] | c)
        else:
            room, to = capacity, len(holds)
            holds.append((s, c))
        bins.append(to)
        offsets.append(capacity - room)
        if room - size >= least:
            insort(by_room, (room - size, to))
    return bins, offsets


def _measure(capacity: int):
    """Pieces of each document: full ones, which fill a bin, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            sizes = [len(t.as_py().split()) if t.is_valid else 0 for t in texts]
            counts = [max(1, -(-n // capacity)) for n in sizes]
            rows = np.repeat(np.arange(len(sizes)), counts)
            piece = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, dtype=np.int64)
            words = np.minimum(np.array(sizes, dtype=np.int64)[rows] - piece * capacity, capacity)
            taken = batch.drop_columns(["text"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(piece.astype(np.int32)), pa.array(words)],
                names=[*taken.schema.names, "piece", "n_words"],
            )

    return run


PACKED_SCHEMA = "doc_id long, piece int, n_words long, bin_id string, bin_offset long"


def _packer(capacity: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # Rows that are alike in all of this are alike in everything.
        order = [("n_words", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "_same"))]
        rows = rows.sort_by(order)
        numbers = [rows[c].combine_chunks().dictionary_encode() for c in ("_source", "_cluster")]
        sources, clusters = ([-1 if i is None else i for i in n.indices.to_pylist()] for n in numbers)
        bins, offsets = pack(rows["n_words"].to_pylist(), sources, clusters, capacity)
        shard = key[0].as_py()
        named = rows.select(["doc_id", "piece", "n_words"]).append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins]))
        return named.append_column("bin_offset", pa.array(offsets, pa.int64()))

    return run


def best_fit_packing(
    docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, cluster: str | None = None
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, n_words, bin_id, bin_offset.

    ``docs`` has doc_id, text and source.  A word is ``[^\\x20\\x09-\\x0D]+``.  A document with more than
    ``capacity`` words is cut into pieces of ``capacity`` words and a rest, numbered from 0; one without words
    (a null text too) is one piece of size zero.  A bin's pieces lie one after another from
    bin_offset on and never exceed ``capacity``.

    Two pieces of one source, or of one duplicate cluster, never share a bin.  A null source
    conflicts with nothing.  Clusters are those in the column ``cluster``, null for none, or
    by default texts that are equal after lower-casing A-Z, where texts without a word are in no cluster.

    Pieces are packed in shards of about ``shard_pieces``, dealt by hash, so that a source or a
    cluster of any size is spread and shards work on their own; the result depends on the
    rows alone, not on their partitions.  Null and repeated doc_ids are documents like others; other columns are
    ignored; an empty table gives an empty one.
    """
    text = F.col("text")
    own = F.xxhash64(ascii_lower(text)) if cluster is None else F.xxhash64(cluster)
    none = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == "" if cluster is None else F.col(cluster).isNull()
    rows = docs.select(
        "doc_id",
        text,
        F.col("source").alias("_source"),
        F.when(~none, own).alias("_cluster"),
        F.xxhash64("text", "source").alias("_same"),
    )
    names = "doc_id long, _source string, _cluster long, _same long, piece int, n_words long"
    pieces = materialise(rows.mapInArrow(_measure(capacity), names))
    shards = max(1, -(-pieces.count() // shard_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "_same", "piece"), F.lit(shards)).cast("int")
    return pieces.withColumn("_shard", deal).groupBy("_shard").applyInArrow(_packer(capacity), PACKED_SCHEMA)
