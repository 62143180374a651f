"""SimHash fingerprints and the exact search for those that differ in a few bits.

Fingerprints are dealt to shards by vantage-point trees.  A tree splits at the median Hamming
distance from a vantage point.  If two fingerprints differ in r bits, their distances from
any point differ by r at most, so a fingerprint visits the other side of a split only if it lies
within r of the border: the shards it overlaps.  Inside a shard a tree of the same kind prunes
the pairs further.

Two fingerprints that differ in r bits differ in r // 2 bits at most in one half of them.  So there are
two trees, each measuring one half and searching r // 2 around; both measures obey the triangle
inequality, and borders that narrow let a fingerprint visit far fewer shards than one tree with r would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import hash_sample
from faultline.llm.components import components
from faultline.session import materialise

SEED = 42
MASKS = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
#: Fingerprints that shape the trees, for each shard and at most; all are searched.
SHARD_SAMPLE, SAMPLE = 32, 1 << 18
#: Fingerprints at home in a shard, about.
SHARD = 2048
#: Below, a block of pairs is compared as it is.
SMALL = 96
_SUM_ROWS = 1 << 15


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    parts = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not parts:
        return np.empty(0, dtype=np.uint64)
    hash64 = xxhash.xxh64_intdigest
    runs = range(max(1, len(parts) - words + 1))
    return np.array([hash64(b" ".join(parts[i : i + words]), SEED) for i in runs], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero of none.  Signed, as a BIGINT."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SUM_ROWS):
        part = hashes[at : at + _SUM_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def _fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in texts]
            others = [name for name in batch.schema.names if name != "text"]
            columns = [*(batch[name] for name in others), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every whole text, A-Z lower-cased; a text without words has fingerprint zero."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprinter(words), "doc_id long, fp long")


@dataclass
class Node:
    """An inner node (vantage, border, two sides) or, with ``shard`` 0 or more, a leaf."""

    shard: int = -1
    vantage: int = 0
    border: int = 0
    near: Node | None = None
    far: Node | None = None


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))


def split(points: np.ndarray, mask: int) -> tuple[int, int] | None:
    """Vantage and border that halve the points best and spread them most, of a few tries."""
    best, found = None, None
    for vantage in points[:: max(1, len(points) // 5)][:5]:
        d = _distance(points, int(vantage), mask)
        border = int(np.median(d))
        border -= int((d <= border - 1).sum() * 2 >= len(d))
        near = int((d <= border).sum())
        if 0 < near < len(d):
            worth = (abs(2 * near - len(d)) / len(d), -float(d.std()))
            if best is None or worth < best:
                best, found = worth, (int(vantage), border)
    return found


def grow(sample: np.ndarray, mask: int, depth: int, shards: list[int]) -> Node:
    """A tree over the sample; ``shards`` is a counter that numbers the leaves."""
    place = split(sample, mask) if depth and len(sample) >= 8 else None
    if place is None:
        shards[0] += 1
        return Node(shard=shards[0] - 1)
    near = _distance(sample, place[0], mask) <= place[1]
    return Node(
        vantage=place[0],
        border=place[1],
        near=grow(sample[near], mask, depth - 1, shards),
        far=grow(sample[~near], mask, depth - 1, shards),
    )


def visits(node: Node, points: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in ``points``) of all shards that may hold a point within ``radius``."""
    stack = [(node, np.arange(len(points)))]
    while stack:
        at, own = stack.pop()
        if not len(own):
            continue
        if at.shard >= 0:
            yield at.shard, own
            continue
        d = _distance(points[own], at.vantage, mask).astype(np.int64)
        stack.append((at.near, own[d - radius <= at.border]))
        stack.append((at.far, own[d + radius > at.border]))


def pairs_within(
    home: np.ndarray, guests: np.ndarray, mask: int, reach: int, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in home, in guests) of pairs at most ``radius`` apart: all that differ in ``reach`` masked bits or fewer."""
    stack = [(np.arange(len(home)), np.arange(len(guests)))]
    while stack:
        h, g = stack.pop()
        if not len(h) or not len(g):
            continue
        place = split(home[h], mask) if len(h) > SMALL else None
        if place is None:
            step = max(1, (1 << 21) // len(h))
            for at in range(0, len(g), step):
                some = g[at : at + step]
                met = np.bitwise_count(home[h][:, None] ^ guests[some][None, :]) <= radius
                i, j = np.nonzero(met)
                yield h[i], some[j]
            continue
        dh = _distance(home[h], place[0], mask)
        dg = _distance(guests[g], place[0], mask).astype(np.int64)
        stack.append((h[dh <= place[1]], g[dg - reach <= place[1]]))
        stack.append((h[dh > place[1]], g[dg + reach > place[1]]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each point's group, by hooking and pointer jumping."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] < root).any():
                root = root[root]
    return root


def _shard_linker(radius: int):
    def link(key: tuple, rows: pa.Table) -> pa.Table:
        mask = MASKS[key[0].as_py() % 2]
        points, at_home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(zero_copy_only=False)
        home = np.flatnonzero(at_home)
        found = pairs_within(points[home], points, mask, radius // 2, radius)
        root = _roots(len(points), ((home[i], j) for i, j in found))
        linked = root != np.arange(len(points))
        return pa.table({"a": points[linked].view(np.int64), "b": points[root[linked]].view(np.int64)})

    return link


def _router(trees: list[Node], parts: dict[int, int], radius: int, only_home: bool):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            points = fp.view(np.uint64)
            # Equal work for the parts of a crowded shard, whatever bits its members share.
            deal = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for t, tree in enumerate(trees):
                homes = np.empty(len(points), dtype=np.int64)
                for shard, own in visits(tree, points, MASKS[t], 0):
                    homes[own] = shard
                for shard, own in visits(tree, points, MASKS[t], 0 if only_home else radius // 2):
                    many = parts.get(2 * shard + t, 1)
                    for part in range(many):
                        home = (homes[own] == shard) & (deal[own] % np.uint64(many) == part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(own), 2 * shard + t, dtype=np.int64)),
                                pa.array(np.full(len(own), part, dtype=np.int32)),
                                pa.array(fp[own]),
                                pa.array(home),
                            ],
                            names=["shard", "part", "fp", "home"],
                        )

    return route


def link_fingerprints(distinct: DataFrame, radius: int = 3, shard_size: int = SHARD) -> DataFrame:
    """(a, b): links that join all fingerprints at most ``radius`` bits apart, over any chain of them.

    ``distinct`` is (fp) without repeats.  Not every pair is listed: of the pairs found in a shard
    a row for each member remains, which links it to the group's least, so a crowd of n
    fingerprints gives about n rows.  Crowded shards are cut into parts that all visitors see.
    """
    total = distinct.count()
    depth = max(0, (max(1, total // shard_size) - 1).bit_length())
    size = min(SAMPLE, SHARD_SAMPLE << depth)
    sample = distinct.filter(hash_sample(F.xxhash64("fp"), size, total)).toArrow()["fp"]
    sample = np.sort(sample.to_numpy().view(np.uint64))
    trees = [grow(sample, mask, depth, [0]) for mask in MASKS]
    schema = "shard long, part int, fp long, home boolean"
    crowded = {}
    if total:
        # At most one row for a shard, and there are no more shards than sampled fingerprints.
        counts = distinct.mapInArrow(_router(trees, {}, radius, True), schema).groupBy("shard").count()
        crowded = {r["shard"]: -(-r["count"] // (4 * shard_size)) for r in counts.filter(F.col("count") > 4 * shard_size).collect()}
    routed = distinct.mapInArrow(_router(trees, crowded, radius, False), schema)
    return routed.groupBy("shard", "part").applyInArrow(_shard_linker(radius), "a long, b long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, _least, _group): the distinct fingerprints, their smallest doc_id and their component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    groups = components(link_fingerprints(distinct.select("fp"), radius), "a", "b")
    group = F.coalesce("component", "fp").alias("_group")
    return distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "_least", group)


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link if ``radius`` bits or fewer differ; component_id is the smallest doc_id that
    links reach, the document's own included.  Empty and null texts and texts of only white
    space have fingerprint zero and link like any other.  A null doc_id names no component: a group of nulls
    alone has component_id null.  Repeated rows are rows of one group; other columns are ignored;
    an empty table gives an empty one.
    """
    prints = materialise(fingerprints(docs, words))
    of_print = _grouped(prints, radius)
    least = of_print.groupBy("_group").agg(F.min("_least").alias("component_id"))
    named = of_print.join(least, "_group").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", digits, "component_id")


def drop_simhash_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group that ``simhash_groups`` finds: the smallest doc_id's.

    Of several texts of that doc_id in a group the one with the smallest hash stays, of equal rows one;
    a null doc_id stays only where its group has no other.  All columns are kept as they are; an
    empty table gives an empty one.
    """
    text = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("other"), "text").alias("_h2")]
    rows = docs.select("doc_id", "text", *text)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _h1 long, _h2 long, fp long"
    prints = materialise(rows.mapInArrow(_fingerprinter(words), schema))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h1", "_h2")
    of_print = prints.groupBy("fp").agg(F.min(first).alias("_first"))
    groups = _grouped(prints, radius).select(F.col("fp").alias("_fp"), "_group")
    stays = of_print.join(groups, F.col("fp") == F.col("_fp")).groupBy("_group").agg(F.min("_first").alias("_f"))
    stays = stays.select(F.col("_f.doc_id").alias("_id"), F.col("_f._h1").alias("_k1"), F.col("_f._h2").alias("_k2"))
    # The document is one value, so that no column of it meets a name used here.
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", *text)
    here = (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    one = F.row_number().over(Window.partitionBy("_h1", "_h2", "doc_id").orderBy(F.lit(1)))
    return marked.join(stays, here).withColumn("_one", one).filter("_one = 1").select("_doc.*")
