"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed length.  The
mix is a sequence of slots, cut into output shards; every shard draws how many of its slots
each source fills, a multinomial draw under the condition that the shards' counts add up to the
source's total.  The i-th slot of a source is mapped through a pseudorandom permutation of the
source's blocks, so a block is used again only after all others, and slots meet blocks in a
join on (source, block).

Draws and permutations are functions of the seed and of the numbers of blocks, so every task
computes its own part and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import small_batches
from faultline.session import materialise

#: Documents of one source that are summed in one window, about.
BUCKET_DOCS = 16_384
#: Slots that are drawn together, at most; numpy's hypergeometric draw takes no more.
STRATUM = 10**9


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    words: int
    target: float
    blocks: int
    slots: int


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none above ``cap`` times its size.

    What a capped source gives up is shared by weight among the others.
    """
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > cap * sizes[i]]
        for i in over or free:
            targets[i] = float(cap * sizes[i]) if over else weights[i] * share
        if not over:
            break
        free = [i for i in free if i not in set(over)]
        left -= sum(targets[i] for i in over)
    return targets


def permuted(i: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size-1 at the places ``i``: four Feistel rounds, walked into range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            x = right + np.uint64((key + turn * 0x9E3779B97F4A7C15) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among ``n`` balls taken from the urn.

    An urn of more than a stratum is parted in proportion (the largest remainders get one more), so
    that the strata have the urn's shares and the draws inside them are exact.
    """
    total = int(colours.sum())
    if total < STRATUM:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    shares = [int(c) * n for c in colours]
    out = np.array([s // total for s in shares], dtype=np.int64)
    order = sorted(range(len(shares)), key=lambda i: (-(shares[i] % total), i))
    out[order[: n - int(out.sum())]] += 1
    return out


def shard_counts(totals: Sequence[int], shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in earlier shards, slots of each source in this one).

    The shards are split in halves again and again, each time by a draw that the seed and the
    place of the split fix, so the result needs one walk down and no other shard.
    """
    here, before = np.array(totals, dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
    first, end = 0, -(-int(here.sum()) // shard_slots)
    while end - first > 1:
        middle = (first + end) // 2
        rng = np.random.Generator(np.random.PCG64([seed, first, end]))
        left = _draw(rng, here, min(int(here.sum()), (middle - first) * shard_slots))
        if shard < middle:
            here, end = left, middle
        else:
            before, here, first = before + left, here - left, middle
    return before, here


SLOT_SCHEMA = "shard long, slot int, source_no int, block long"


def _slot_filler(sources: list[Source], shard_slots: int, seed: int):
    totals = [s.slots for s in sources]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_pylist():
                before, counts = shard_counts(totals, shard, shard_slots, seed)
                numbers = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                blocks = np.empty(len(numbers), dtype=np.int64)
                at = 0
                for s, start, n in zip(sources, before, counts):
                    if n:
                        i = start + np.arange(n)
                        lap, place = i // s.blocks, i % s.blocks
                        for turn in np.unique(lap):
                            key = int(np.random.SeedSequence([seed, s.number, int(turn)]).generate_state(1, np.uint64)[0])
                            own = lap == turn
                            blocks[at : at + n][own] = permuted(place[own], s.blocks, key)
                    at += n
                order = np.random.Generator(np.random.PCG64([seed, shard, 2**32])).permutation(len(numbers))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(numbers), shard, dtype=np.int64)),
                        pa.array(np.arange(len(numbers), dtype=np.int32)),
                        pa.array(numbers[order]),
                        pa.array(blocks[order]),
                    ],
                    names=["shard", "slot", "source_no", "block"],
                )

    return fill


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        sizes = [len(t.as_py().split()) if t.is_valid else 0 for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["source"], batch["_same"], pa.array(sizes, pa.int64())],
            names=["doc_id", "source", "_same", "size"],
        )


class Mix:
    """A mix of ``docs`` (doc_id, text, source): its sources, slots and the documents' places.

    A word is ``[^\\x20\\x09-\\x0D]+``; a null text has none.  Sources in code-point order, null
    last, take ``weights`` in turn.  Their targets share all words by weight; a target stops
    at ``cap`` times its source's words and the excess is shared anew.  A block is used at
    most ``cap`` times.  The table of sources, one row for a source, is the one thing held by the
    driver.  Null or repeated doc_ids are documents like others; an empty table makes an empty mix.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = (5, 2, 1),
        cap: int = 3,
        block_words: int = 128,
        shard_slots: int = 4096,
        seed: int = 42,
    ):
        self.spark, self.block_words, self.shard_slots, self.seed = docs.sparkSession, block_words, shard_slots, seed
        plain = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("_same"))
        schema = "doc_id long, source string, _same long, size long"
        counted = materialise(plain.mapInArrow(_count_words, schema))
        found = counted.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        targets = water_fill([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], cap)
        self.sources = []
        for i, (r, target) in enumerate(zip(found, targets)):
            blocks = -(-r.words // block_words)
            slots = min(round(target * blocks / r.words), cap * blocks) if r.words else 0
            self.sources.append(Source(i, r.source, r.words, target, blocks, slots))
        most = max((r.docs for r in found), default=0)
        self.spans = self._place(counted, max(64, -(-most // BUCKET_DOCS)))

    def source_table(self) -> DataFrame:
        rows = [(s.number, s.name, s.words, s.target) for s in self.sources]
        return self.spark.createDataFrame(rows, "source_no int, _source string, source_size long, target double")

    def _place(self, counted: DataFrame, buckets: int) -> DataFrame:
        """(source_no, doc_id, _same, _nth, size, start): where a document's words lie in its source.

        Running sums inside buckets of a source and over its buckets, never over a whole source.
        """
        rows = counted.join(F.broadcast(self.source_table()), F.col("source").eqNullSafe(F.col("_source"))).select(
            "source_no", "doc_id", "_same", "size", F.pmod(F.xxhash64("doc_id", "_same"), F.lit(buckets)).alias("_b")
        )
        totals = rows.groupBy("source_no", "_b").agg(F.sum("size").alias("_sum"))
        over = Window.partitionBy("source_no").orderBy("_b")
        totals = totals.select("source_no", "_b", (F.sum("_sum").over(over) - F.col("_sum")).alias("_before"))
        inside = Window.partitionBy("source_no", "_b").orderBy("doc_id", "_same")
        placed = rows.withColumn(
            "_here", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        ).withColumn("_nth", F.row_number().over(Window.partitionBy("source_no", "_b", "doc_id", "_same").orderBy("_here")))
        return materialise(
            placed.join(totals, ["source_no", "_b"]).select(
                "source_no", "doc_id", "_same", "_nth", "size", (F.col("_before") + F.col("_here")).alias("start")
            )
        )

    def slots(self) -> DataFrame:
        """(shard, slot, source_no, block): the mix, a row for each block-sized slot.

        The planner takes it for as small as the range of shards it is made from; hint joins with it.
        """
        shards = -(-sum(s.slots for s in self.sources) // self.shard_slots)
        some = self.spark.range(0, shards, 1, max(1, min(shards, self.spark.sparkContext.defaultParallelism * 4)))
        return some.mapInArrow(_slot_filler(self.sources, self.shard_slots, self.seed), SLOT_SCHEMA)

    def pieces(self) -> DataFrame:
        """Documents cut at block borders: the columns of ``spans``, block, and first and n in words."""
        cut, start, size = F.lit(self.block_words), F.col("start"), F.col("size")
        first, last = F.floor(start / cut), F.floor((start + size - 1) / cut)
        spread = self.spans.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.greatest(start, F.col("block") * cut)
        end = F.least(start + size, (F.col("block") + 1) * cut)
        return spread.withColumn("first", begin - start).withColumn("n", end - begin)

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target (its source's), taken in words."""
        uses = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("_uses"))
        words = F.col("n") * F.coalesce("_uses", F.lit(0))
        per_doc = (
            self.pieces()
            .join(uses.hint("merge"), ["source_no", "block"], "left")
            .groupBy("source_no", "doc_id", "start", "size")  # words have one place in a source
            .agg(F.sum(words).alias("taken"))
            .select("source_no", "doc_id", "size", "taken")
        )
        empty = self.spans.filter("size = 0").select("source_no", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        return (
            per_doc.union(empty)
            .join(F.broadcast(self.source_table()), "source_no")
            .select("doc_id", "size", "source_size", "target", "taken")
        )


def _cut_texts(names: list[str]):
    """Columns come by place: those of ``names`` but shard and slot, then the list of the document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                *columns, places = batch.slice(low, 256).columns
                rows = np.repeat(np.arange(len(places)), places.value_lengths())
                first, n, shard, slot = places.flatten().flatten()
                words = [t.as_py().split() for t in columns[at].cast(pa.binary())]
                cuts = zip(rows.tolist(), first.to_pylist(), n.to_pylist())
                texts = [b" ".join(words[row][a : a + k]).decode() for row, a, k in cuts]
                own = {"text": pa.array(texts, columns[at].type)}
                if "n_chars" in names:
                    own["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
                taken = pa.array(rows)
                columns = [own[c] if c in own else column.take(taken) for c, column in zip(names, columns)]
                yield pa.RecordBatch.from_arrays([*columns, shard, slot], names=names)

    return cut


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows of the columns of ``docs`` plus shard and slot: a row for each piece of a slot.

    A piece is the part of a document that lies in the slot's block, its words joined by single
    spaces; n_chars, where there is one, counts it anew.  Documents without words are in no piece.
    ``settings`` are those of ``Mix``.
    """
    small_batches(docs.sparkSession)
    mix, own = Mix(docs, **settings), [c for c in docs.columns if c not in ("shard", "slot")]
    pieces = mix.pieces().join(F.broadcast(mix.source_table().select("source_no", "_source")), "source_no")
    # A document's pieces come to it as one list, so its text moves once however many they are.
    piece = F.struct("first", "n", "shard", "slot")
    used = (
        pieces.join(mix.slots().hint("merge"), ["source_no", "block"])
        .groupBy("_source", F.col("doc_id").alias("_id"), F.col("_same").alias("_hash"), F.col("_nth").alias("_which"))
        .agg(F.collect_list(piece).alias("_pieces"))
    )
    # Rows that repeat source, doc_id and text have a place each; they are numbered here as there.
    # The document is one value, so that no column of it meets a name used here.
    alike = Window.partitionBy("source", "doc_id", "_same").orderBy(F.lit(1))
    numbered = docs.select(F.struct(*own).alias("_doc"), "source", "doc_id", F.xxhash64("text").alias("_same"))
    numbered = numbered.withColumn("_nth", F.row_number().over(alike))
    same = (
        F.col("source").eqNullSafe(F.col("_source"))
        & F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.col("_same") == F.col("_hash"))
        & (F.col("_nth") == F.col("_which"))
    )
    kinds = {**dict(docs.dtypes), "n_chars": "bigint"}
    schema = T.StructType(
        [T.StructField(c, T.LongType()) if c == "n_chars" else docs.schema[c] for c in own]
        + [T.StructField("shard", T.LongType()), T.StructField("slot", T.IntegerType())]
    )
    met = numbered.join(used, same).select(
        *[F.col("_doc")[c].cast(kinds[c]).alias(f"_{i}") for i, c in enumerate(own)], "_pieces"
    )
    return met.mapInArrow(_cut_texts([*own, "shard", "slot"]), schema)
