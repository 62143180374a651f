"""Lines that many documents repeat, dropped through a sharded minimal perfect hash.

Every line becomes a 128-bit hash.  The hashes found in enough documents are dealt to shards,
and each shard is an index of flat arrays: a minimal perfect hash places a line hash in a slot, the
slot's 64-bit fingerprint tells a member from a stranger, and two more arrays hold its count
and the document that keeps it.  Documents send their line hashes to the shards and probe the
arrays; no text of a line is stored in the index, joined or compared.

A line that a large part of the documents hold would be a large part of the probes of its shard.
Those lines are at most ``HOT_LINES`` by count, so they are broadcast and settled map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import let
from faultline.llm.common import SPACE, ascii_lower
from faultline.session import materialise

#: At most so many lines hold a share of 1 / HOT_LINES of all repeats each.
HOT_LINES = 1024
#: Line hashes and probes that a shard holds on average, at most.
SHARD_KEYS, SHARD_PROBES = 16_384, 131_072

_GOLDEN = 0x9E3779B97F4A7C15


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the hashes for each level."""
    x = keys + np.uint64(_GOLDEN * (level + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Distinct 64-bit keys to 0 .. n-1, in about three bits a key.

    Level by level, a key that hashes alone onto a bit owns that bit; the keys that met go on to the
    next level.  The slot of a key is the number of owned bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            ends = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(np.concatenate(([0], ends[:-1])) + total)
            total += int(ends[-1])
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """Keys must be distinct."""
        left, levels = np.asarray(keys, dtype=np.uint64), []
        while len(left):
            bits = np.zeros((2 * len(left) + 63) // 64, dtype=np.uint64)
            at = _mix(left, len(levels)) % np.uint64(64 * len(bits))
            taken = np.bincount(at.astype(np.int64), minlength=64 * len(bits))
            alone = taken[at.astype(np.int64)] == 1
            mine = at[alone]
            np.bitwise_or.at(bits, (mine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (mine & np.uint64(63)))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for some strangers; other strangers get a member's slot."""
        keys = np.asarray(keys, dtype=np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = _mix(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            word, bit = word[hit], bit[hit]
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = before[word] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype=np.int64)
        return sizes.tobytes() + b"".join(bits.tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        cuts = 8 * (1 + n) + 8 * np.concatenate(([0], np.cumsum(sizes)))
        return cls([np.frombuffer(data, np.uint64, int(k), int(at)) for k, at in zip(sizes, cuts)])


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hash(key: Column) -> Column:
    """128 bits: shard and slot come from h1, the fingerprint is h2."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("fingerprint"), key).alias("h2"))


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2), once for a line hash and document row."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    # Sorted, as array_distinct compares structs each with each.
    def distinct(found: Column) -> Column:
        return F.filter(found, lambda h, i: (i == 0) | (h != F.get(found, i - 1)))

    hashes = let(F.array_sort(F.transform(keys, line_hash)), distinct)
    return docs.select("doc_id", F.explode(hashes).alias("_h")).select("doc_id", "_h.h1", "_h.h2")


INDEX_SCHEMA = "_shard int, slots binary, fingerprints binary, counts binary, keepers binary, no_keeper binary"


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    h1 = rows["h1"].to_numpy().view(np.uint64)
    # Two hashes may share h1 and differ in h2; the perfect hash needs distinct keys.
    mixed = h1 ^ _mix(rows["h2"].to_numpy().view(np.uint64), 0)
    function = MinimalPerfectHash.build(mixed)
    slot = function.slots(mixed)

    def in_slots(values: np.ndarray) -> bytes:
        out = np.empty_like(values)
        out[slot] = values
        return out.tobytes()

    return pa.table(
        {
            "_shard": pa.array([key[0].as_py()], pa.int32()),
            "slots": [function.to_bytes()],
            "fingerprints": [in_slots(rows["h2"].to_numpy())],
            "counts": [in_slots(rows["n_docs"].to_numpy())],
            "keepers": [in_slots(rows["keeper"].fill_null(0).to_numpy())],
            "no_keeper": [in_slots(rows["keeper"].is_null().to_numpy(zero_copy_only=False))],
        }
    )


def _prober(min_docs: int):
    def probe(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return probes.slice(0, 0).select(["doc_id", "h1", "h2"])
        blob = {name: index[name][0].as_py() for name in index.column_names if name != "_shard"}
        function = MinimalPerfectHash.from_bytes(blob["slots"])
        h2 = probes["h2"].to_numpy()
        slot = function.slots(probes["h1"].to_numpy().view(np.uint64) ^ _mix(h2.view(np.uint64), 0))
        found = np.flatnonzero(slot >= 0)
        found = found[np.frombuffer(blob["fingerprints"], np.int64)[slot[found]] == h2[found]]
        at = slot[found]
        doc, no_doc = probes["doc_id"].fill_null(0).to_numpy()[found], probes["doc_id"].is_null().to_numpy()[found]
        nobody = np.frombuffer(blob["no_keeper"], bool)[at]
        keeps = np.where(nobody | no_doc, nobody & no_doc, np.frombuffer(blob["keepers"], np.int64)[at] == doc)
        drop = found[(np.frombuffer(blob["counts"], np.int64)[at] >= min_docs) & ~keeps]
        return probes.select(["doc_id", "h1", "h2"]).take(pa.array(drop))

    return probe


def _line_dropper(min_chars: int):
    """A function of (text, lost h1, lost h2): the text without the lines of those hashes, and how many went."""
    seeded = xxhash.xxh64_intdigest(b"fingerprint", 42)  # as ``line_hash`` chains its values

    def cut(text: bytes, lost: set[tuple[int, int]]) -> tuple[str, int]:
        kept, lines = [], text.split(b"\n")
        for line in lines:
            key = line.strip(SPACE.encode()).lower()  # bytes: only A-Z
            hashed = (xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, seeded))
            if hashed not in lost or len(key.decode("utf-8", "replace")) < min_chars:
                kept.append(line)
        return b"\n".join(kept).decode("utf-8", "replace"), len(lines) - len(kept)

    @F.pandas_udf("text string, dropped long")
    def dropper(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, h1, h2):
            if text is None:
                out.append((None, 0))
            else:
                lost = zip(np.asarray(a).astype(np.int64).view(np.uint64), np.asarray(b).astype(np.int64).view(np.uint64))
                out.append(cut(text, {(int(x), int(y)) for x, y in lost}))
        return pd.DataFrame(out, columns=["text", "dropped"])

    return dropper


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, h1, h2): the line hashes that each document loses."""
    hashes = materialise(_line_hashes(docs, min_chars))
    repeated = materialise(
        hashes.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    probes = hashes.count()
    keys, repeats = repeated.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    shards = max(64, -(-keys // SHARD_KEYS), -(-probes // SHARD_PROBES))
    is_hot = F.col("n_docs") * HOT_LINES >= repeats  # so there are at most HOT_LINES

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_shard", F.pmod("h1", F.lit(shards)).cast("int"))

    index = materialise(dealt(repeated.filter(~is_hot)).groupBy("_shard").applyInArrow(_build, INDEX_SCHEMA))
    hot = F.broadcast(repeated.filter(is_hot).select("h1", "h2", "keeper", F.lit(True).alias("_hot")))
    met = hashes.join(hot, ["h1", "h2"], "left")
    by_hot = met.filter(F.col("_hot") & ~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "h1", "h2")
    by_index = (
        dealt(met.filter("_hot is null").select("doc_id", "h1", "h2"))
        .groupBy("_shard")
        .cogroup(index.groupBy("_shard"))
        .applyInArrow(_prober(min_docs), "doc_id long, h1 long, h2 long")
    )
    return by_hot.union(by_index)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with two more columns, n_lines and n_dropped, and with ``text`` rid of repeated lines.

    A line's key is the line without white space at both ends, A-Z lower-cased.  Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` document rows lose all their
    lines except in the documents with the largest doc_id that holds them, where repeats inside
    the document stay too.  The other lines stay as they are, joined by a newline.

    A null or empty text is one empty line; a null text that loses nothing stays null.  A null
    doc_id is smaller than any other; rows that repeat a doc_id count each but keep or lose alike.
    Columns named n_lines or n_dropped are replaced; an empty table gives an empty one.
    """
    drops = (
        dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_lost"))
        .select(F.col("doc_id").alias("_lost_id"), "_lost")
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The document is one value, so that no column of it meets a name used here.
    rows = docs.select(F.struct(*own).alias("_doc"), "doc_id", "text")
    lines = lines_of(F.col("text"))
    # Texts that lose nothing are not sent; a set of the lost hashes is looked up once a line.
    cut = _line_dropper(min_chars)(F.when(F.col("_lost").isNotNull(), F.col("text")).cast("binary"), "_lost.h1", "_lost.h2")

    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_lost_id")), "left").select(
        "_doc",
        "text",
        F.size(lines).cast("long").alias("_n"),
        F.col("_lost").isNull().alias("_whole"),
        cut.alias("_cut"),
    )
    text = F.when(F.col("_whole"), F.col("text")).otherwise(F.col("_cut.text"))
    return met.select(
        *[text.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in own],
        F.col("_n").alias("n_lines"),
        F.when(F.col("_whole"), 0).otherwise(F.col("_cut.dropped")).cast("long").alias("n_dropped"),
    )
