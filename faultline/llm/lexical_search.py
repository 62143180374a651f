"""Ranked lexical search over bit-sliced Bloom signatures, exact.

The index packs documents into blocks of like size.  A block is a bit matrix with a column for each
document: every slice (row) is a bitmap over the block's documents, and a term sets its bits in the
slices its hash names.  A term that occurs often sets more of them, under the names (term, 2),
(term, 3), ...  To search, the bitmaps of a term's slices are intersected: a superset of the
documents that hold the term, or hold it that often.  Weighted by what the term can add to a
score at most, their sum bounds every document's score from above.

The highest bounds are scored exactly first; the worst of the k best of them is a floor for the item.
All documents whose bound reaches the floor are then scored exactly from their whole texts, so
nothing is lost to a bit that was set by another term, only time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import UPPER, runs, shared_folder
from faultline.session import materialise

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
#: Documents of a block, at most, and slices of its matrix for each entry of its largest document.
BLOCK_DOCS, BITS, HASHES = 2048, 20, 3
#: A term that occurs so often has an entry more for each of these.
LEVELS = (2, 3, 4, 6, 8, 16, 64)
#: Bytes of a slice, eight documents each, that are weighed at once.
COLUMNS = 64
#: Terms of the items that are searched at once, at most.
QUERY_TERMS = 1 << 15
#: Texts are taken apart in runs of about so many characters.
RUN_CHARS = 1 << 22


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(_LOWER)) if text else []


def _hash(term: str) -> int:
    """64 bits, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the entries (term, level); level 0 says that the term is there."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(entries: np.ndarray, width: int) -> np.ndarray:
    """The HASHES slices of each entry in a matrix of ``width`` (a power of two) slices."""
    first, step = entries & np.uint64(width - 1), (entries >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(k) * step) & np.uint64(width - 1) for k in range(HASHES)]).astype(np.int32)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def document_m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // n_terms


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds; grows with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


#: Documents named by so few candidates are found by broadcast, by a shuffle of the texts else.
BROADCAST_NAMES = 1 << 18
#: Parts in which the candidates of an item are ranked first.
PARTS = 64

INDEX = "docs binary, keys binary, others binary, sizes binary, no_id binary, width int, slices binary"


class _Packer:
    """Blocks of documents whose signatures have one width."""

    def __init__(self):
        self.open: dict[int, list] = {}

    def add(self, doc_id: int | None, key: tuple[int, int], hashes: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        levels = [_entries(hashes, 0)]
        for level in LEVELS:
            often = counts >= level
            if not often.any():
                break
            levels.append(_entries(hashes[often], level))
        entries = np.concatenate(levels)
        width = 1 << max(6, int(BITS * len(entries) - 1).bit_length())
        block = self.open.setdefault(width, [])
        block.append((doc_id, key, int(counts.sum()), _slices(entries, width).ravel()))
        # A matrix of long documents has fewer columns, so that it stays about as large.
        if len(block) >= max(8, min(BLOCK_DOCS, (1 << 25) // width)):
            yield self._close(width)

    def _close(self, width: int) -> dict:
        block = self.open.pop(width)
        columns = -(-len(block) // 8)
        matrix = np.zeros((width, columns), dtype=np.uint8)
        for at, (*_, slices) in enumerate(block):
            matrix[slices, at >> 3] |= np.uint8(1 << (at & 7))
        ids, keys, sizes = zip(*(row[:3] for row in block))
        return {
            "docs": np.array([i or 0 for i in ids], dtype=np.int64).tobytes(),
            "keys": np.array([k[0] for k in keys], dtype=np.int64).tobytes(),
            "others": np.array([k[1] for k in keys], dtype=np.int64).tobytes(),
            "sizes": np.array(sizes, dtype=np.int64).tobytes(),
            "no_id": np.array([i is None for i in ids]).tobytes(),
            "width": width,
            "slices": matrix.tobytes(),
        }

    def rest(self) -> Iterator[dict]:
        for width in list(self.open):
            yield self._close(width)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, known = _Packer(), {}
    for run in runs(batches, RUN_CHARS):
        for doc_id, *key, text in run:
            counts = Counter(terms_of(text))
            if not counts:
                continue
            for term in counts:
                if term not in known:
                    known[term] = _hash(term)
            hashes = np.fromiter((known[t] for t in counts), np.uint64, len(counts))
            for block in packer.add(doc_id, key, hashes, np.fromiter(counts.values(), np.int64, len(counts))):
                yield pa.RecordBatch.from_pylist([block], schema=_INDEX_ARROW)
        if len(known) > 1 << 19:
            known.clear()
    for block in packer.rest():
        yield pa.RecordBatch.from_pylist([block], schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema(
    [
        ("docs", pa.binary()),
        ("keys", pa.binary()),
        ("others", pa.binary()),
        ("sizes", pa.binary()),
        ("no_id", pa.binary()),
        ("width", pa.int32()),
        ("slices", pa.binary()),
    ]
)


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, 128 bits that tell texts apart, text."""
    key, other = F.xxhash64("text"), F.xxhash64(F.lit("other"), "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key"), other.alias("_other"), "text")


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """Write the blocks of ``docs`` (doc_id, text) to ``folder`` and return them."""
    _key(docs).mapInArrow(_index, INDEX).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _df_counter(wanted: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = wanted.value, Counter()
        for rows in runs(batches, RUN_CHARS):
            for (text,) in rows:
                found.update(t for t in set(terms_of(text)) if t in terms)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(list(found), pa.string()), "df": pa.array(list(found.values()), pa.int64())}
        )

    return run


class _Items:
    """A block of items: their terms (numbered) with weights and repeats."""

    def __init__(self, items: list[dict[str, int]], df: dict[str, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = sorted({t for item in items for t in item})
        place = {t: k for k, t in enumerate(self.terms)}
        self.weights = np.array([weight(n_docs, df.get(t, 0)) for t in self.terms], dtype=np.int64)
        self.hashes = np.array([_hash(t) for t in self.terms], dtype=np.uint64)
        self.items = [
            (np.array([place[t] for t in item], dtype=np.int64), np.array(list(item.values()), dtype=np.int64))
            for item in items
        ]

    def bounds(self, block: dict) -> np.ndarray:
        """An upper bound of every item's score for every document of the block, items in rows."""
        sizes = np.frombuffer(block["sizes"], np.int64)
        matrix = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
        m = document_m(sizes, self.n_docs, self.n_terms)
        return np.concatenate(
            [
                self._bounds(matrix[:, at : at + COLUMNS], sizes[8 * at : 8 * (at + COLUMNS)], m[8 * at : 8 * (at + COLUMNS)])
                for at in range(0, matrix.shape[1], COLUMNS)
            ],
            axis=1,
        )

    def _bounds(self, matrix: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
        n = len(sizes)
        there = self._present(matrix, np.arange(len(self.terms)), 0)
        live = np.flatnonzero(there.any(axis=1))
        there, gain = there[live], np.zeros((len(self.terms), n), dtype=np.int32)
        steps = (1, *LEVELS)
        for k, level in enumerate(steps):
            if k:
                there = there & self._present(matrix, live, level)
                some = there.any(axis=1)
                live, there = live[some], there[some]
            if not len(live):
                break
            # A term has one less than the next step asks for at most, and never more than the document holds.
            most = np.minimum(steps[k + 1] - 1, sizes) if k + 1 < len(steps) else sizes
            bits = np.unpackbits(there, axis=1, count=n, bitorder="little").astype(bool)
            gain[live] = np.where(bits, part_score(most, m).astype(np.int32), gain[live])
        total = np.zeros((len(self.items), n), dtype=np.int64)
        for row, (terms, repeats) in enumerate(self.items):
            total[row] = (self.weights[terms] * repeats) @ gain[terms].astype(np.int64)
        return total

    def _present(self, matrix: np.ndarray, terms: np.ndarray, level: int) -> np.ndarray:
        at = _slices(_entries(self.hashes[terms], level), len(matrix))
        out = matrix[at[0]]
        for other in at[1:]:
            out = out & matrix[other]
        return out

    def scores(self, text: str | None, wanted: list[int]) -> list[int]:
        """Exact scores of a text for some of the items."""
        counts = Counter(terms_of(text))
        n = sum(counts.values())
        if not n:
            return [0] * len(wanted)
        m = 100 - 25 + (25 * n * self.n_docs) // self.n_terms
        out = []
        for item in wanted:
            terms, repeats = self.items[item]
            score = 0
            for t, times in zip(terms.tolist(), repeats.tolist()):
                tf = counts.get(self.terms[t], 0)
                if tf:
                    score += times * int(self.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            out.append(score)
        return out


CANDIDATE = "item int, doc_id long, _key long, _other long, bound long"


def _above(bounds: np.ndarray, floors: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """What may be among the best: a higher bound than the k-th best, or its score and no larger doc_id."""
    score, doc_id, no_id = (column[:, None] for column in floors.T)
    docs, nobody = np.frombuffer(block["docs"], np.int64), np.frombuffer(block["no_id"], bool)
    before = nobody | ((docs <= doc_id) & (no_id == 0))
    return np.nonzero((bounds > score) | ((bounds == score) & before))


def _candidates(items: Broadcast, floors: Broadcast | None, k: int):
    """Candidates of each block: its k highest bounds of an item, or all bounds that reach the floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                bounds = items.value.bounds(block)
                if floors is None:
                    take = np.argsort(-bounds, axis=1, kind="stable")[:, :k]
                    rows = np.repeat(np.arange(len(bounds)), take.shape[1])
                    columns = take.ravel()
                    some = bounds[rows, columns] > 0
                    rows, columns = rows[some], columns[some]
                else:
                    rows, columns = _above(bounds, floors.value, block)
                docs = np.frombuffer(block["docs"], np.int64)[columns]
                nobody = np.frombuffer(block["no_id"], bool)[columns]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows.astype(np.int32)),
                        pa.array(docs, mask=nobody),
                        pa.array(np.frombuffer(block["keys"], np.int64)[columns]),
                        pa.array(np.frombuffer(block["others"], np.int64)[columns]),
                        pa.array(bounds[rows, columns]),
                    ],
                    names=["item", "doc_id", "_key", "_other", "bound"],
                )

    return run


def _rescore(items: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, RUN_CHARS):
            item, doc, score = [], [], []
            for doc_id, wanted, text in rows:
                item += wanted
                doc += [doc_id] * len(wanted)
                score += items.value.scores(text, wanted)
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(item, pa.int32()),
                    "doc_id": pa.array(doc, pa.int64()),
                    "score": pa.array(score, pa.int64()),
                }
            )

    return run


def _scored(docs: DataFrame, candidates: DataFrame, items: Broadcast) -> DataFrame:
    """(item, doc_id, score) of every row of ``docs`` that a candidate names.

    A candidate names rows by doc_id and text hash: all rows of that name, once for each item.
    """
    named = materialise(
        candidates.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("_other").alias("_o")).agg(
            F.sort_array(F.collect_set("item")).alias("_items")
        )
    )
    if named.count() <= BROADCAST_NAMES:
        named = F.broadcast(named)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & (F.col("_other") == F.col("_o"))
    met = docs.join(named, same).select("doc_id", "_items", "text")
    return met.mapInArrow(_rescore(items), "item int, doc_id long, score long")


def _first(rows: DataFrame, by: list[str], order: list, part: Column, k: int) -> DataFrame:
    """The first k rows of each group, with their ``rank``: those of its parts first, so that no task has all."""
    local = rows.withColumn("_part", F.pmod(part, F.lit(PARTS)))
    near = local.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    near = near.filter(F.col("rank") <= k)
    far = near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return far.filter(F.col("rank") <= k).drop("_part")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    return _first(scored.filter("score > 0"), ["item"], order, F.xxhash64("doc_id"), k)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items, each (item_id, text) once, in blocks of at most QUERY_TERMS terms (one item aside)."""
    block, size = [], 0
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        counts = Counter(terms_of(row.text))
        if not counts:
            continue
        if block and size + len(counts) > QUERY_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, counts))
        size += len(counts)
    if block:
        yield block


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id, score; only scores above 0, equal ones by ascending
    doc_id (a null one first).  Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased; weight and score are those of ``weight`` and ``part_score``, over all documents.

    Null and empty texts have no terms and are never found; texts of any length are used whole.
    Rows that repeat a doc_id count and rank each; an item that is repeated with the same text
    counts once, a null item_id is one more item.  Other columns are left out.  Empty tables give
    an empty one.  Items are searched in blocks of bounded size, documents never meet in pairs.
    """
    spark = docs.sparkSession
    context, source = spark.sparkContext, _key(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = build_index(docs, shared_folder(spark, "signatures"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(s, np.int64) for s in batch["sizes"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [len(s) for s in sizes], "l": [int(s.sum()) for s in sizes]})

    n_docs, n_terms = index.select("sizes").mapInArrow(summed, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    if not n_docs:
        return out
    for block in _item_blocks(items):
        wanted = context.broadcast(dict.fromkeys((t for _, counts in block for t in counts), 0))
        counted = docs.select("text").mapInArrow(_df_counter(wanted), "term string, df long")
        df = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("df").alias("n")).collect()}
        asked = context.broadcast(_Items([counts for _, counts in block], df, n_docs, n_terms))

        highest = [F.desc("bound"), F.asc_nulls_first("doc_id"), "_key", "_other"]
        first = index.mapInArrow(_candidates(asked, None, 2 * k), CANDIDATE)
        first = _first(first, ["item"], highest, F.xxhash64("doc_id", "_key"), 2 * k)
        sure = _best(_scored(source, first, asked), k).filter(F.col("rank") == k).select("item", "score", "doc_id").collect()
        floors = np.zeros((len(block), 3), dtype=np.int64)  # the k-th best so far: score, doc_id, whether that is null
        for row in sure:
            floors[row.item] = row.score, row.doc_id or 0, row.doc_id is None
        candidates = index.mapInArrow(_candidates(asked, context.broadcast(floors), k), CANDIDATE)
        # Copies of a text score alike: those of the k smallest doc_ids stand for all.
        copies = [F.asc_nulls_first("doc_id")]
        candidates = _first(candidates, ["item", "_key", "_other"], copies, F.xxhash64("doc_id"), k)
        best = _best(_scored(source, candidates, asked), k)
        names = spark.createDataFrame(
            [(at, item_id) for at, (item_id, _) in enumerate(block)], "item int, item_id long"
        )
        out = out.union(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
