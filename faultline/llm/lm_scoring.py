"""Log-probabilities of whole texts: word counts, and a self-attention model trained on the corpus.

Every training text is trained on, once.  Texts are encoded once and written down.  In a round each
task steps through its own texts from the same parameters; the outcomes are averaged in a tree of
groups, each parameter weighted by how often its task has met it, and are the next round's start.
Nothing of a task but its parameters moves, and their size is bounded by the tokenizer's vocabulary.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.attention import (
    SCORE_WINDOWS,
    STEP_WINDOWS,
    STRIDE,
    WINDOW,
    Adam,
    Attention,
    Vocabulary,
    learn,
    windows,
)
from faultline.llm.common import shared_folder, small_batches
from faultline.session import materialise

#: Learning rates of the rounds; each training text is in one round.
RATES = (0.02, 0.012, 0.006, 0.003)
#: Words that hold a share of 1 / HOT_WORDS of all tokens each, and are this short, are broadcast.
HOT_WORDS, HOT_BYTES = 1 << 17, 64
#: Words whose ids a worker remembers.
REMEMBERED = 1 << 19
#: Texts are split in runs of about so many bytes, and put into windows in runs of so many ids.
RUN_BYTES, RUN_IDS = 1 << 22, 1 << 17
#: Parameters of a row, and rows that a task averages at most.
BLOCK, FAN_IN = 1 << 16, 16

CODED = (
    "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, "
    "ids binary, rare array<struct<word: binary, tf: int>>, _round int"
)


def _text_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``size`` bytes, a single text aside."""
    run, held = [], 0
    for batch in batches:
        run.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from pa.Table.from_batches(run).combine_chunks().to_batches()
            run, held = [], 0
    if run:
        yield from pa.Table.from_batches(run).combine_chunks().to_batches()


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between white space, A-Z lower-cased: a number for each, the words numbered, their texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
    there = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text has an empty word beyond it
    numbered = words.filter(there).dictionary_encode()
    of = np.repeat(np.arange(len(text)), sizes)[there.to_numpy(zero_copy_only=False)]
    return numbered.indices.to_numpy(), numbered.dictionary.cast(pa.binary()), of


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _text_runs(batches, RUN_BYTES):
        numbers, words, _ = _split(run["text"])
        yield pa.RecordBatch.from_pydict({"word": words, "c": np.bincount(numbers, minlength=len(words))})


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): lower-cased words of ``text`` between white space, and how often they occur."""
    words = texts.select("text").mapInArrow(_counter, "word binary, c long")
    return words.groupBy("word").agg(F.sum("c").alias("c"))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Words:
    """Words that a worker has met, numbered, with their ids one after the other and their counts."""

    def __init__(self, coder, counts: dict[bytes, int], n_train: int):
        self.coder, self.counts, self.n_train = coder, counts, n_train
        self.clear()

    def clear(self) -> None:
        # Number 0 is the end of a text; no word is empty.
        self.known = {b"": 0}
        self.flat = np.array([self.coder.n_vocab], dtype=np.int32)
        self.first, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.count = np.array([self.n_train], dtype=np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of different words."""
        if len(self.known) > REMEMBERED:
            self.clear()
        self.meet([w for w in words if w not in self.known])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def meet(self, new: list[bytes]) -> None:
        """Encode words not met before; the count of one that is not frequent is -1."""
        if not new:
            return
        ids = [self.coder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in new]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(length) - length
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))])
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, length])
        count = np.fromiter((self.counts.get(w, -1) for w in new), np.int64, len(new))
        self.count = np.concatenate([self.count, count])


def _tokenizer(ranks: str, pattern: str):
    """A byte-level tokenizer from a file of ranks, a line for each token."""
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def _listed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows whose ``ids``, written as bytes, are lists of numbers again."""
    kind = _id_type(size)
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch["ids"].cast(pa.large_binary())
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0])
        lists = pa.ListArray.from_arrays(((ends - ends[0]) // kind.itemsize).astype(np.int32), pa.array(ids))
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([lists if name == "ids" else batch[name] for name in names], names=names)


def _encoder(ranks: str, pattern: str, hot: Broadcast, n_train: int):
    """Ids, sums over frequent words and the list of the others, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(ranks, pattern)
        memory, kind = _Words(coder, hot.value, n_train), _id_type(coder.n_vocab + 1)
        for rows in _text_runs(batches, RUN_BYTES):
            numbers, words, doc = _split(rows["text"])
            known, many = memory.numbers(words.to_pylist()), len(words)
            sizes = np.bincount(doc, minlength=rows.num_rows) + 1
            ends = np.cumsum(sizes)
            starts, met = ends - sizes, np.zeros(ends[-1], np.int64)
            met[np.arange(len(doc)) + doc] = known[numbers]
            ids = memory.flat[_spread(memory.first[met], memory.length[met])].astype(kind)
            id_ends = np.cumsum(np.add.reduceat(memory.length[met], starts))

            logs = np.where(memory.count >= 0, np.log10(np.maximum(memory.count, 0) + 1.0), 0.0)
            cold = (memory.count[known] < 0)[numbers]
            pairs, tf = np.unique(doc[cold] * many + numbers[cold], return_counts=True)
            rare_ends = np.searchsorted(pairs, np.arange(rows.num_rows + 1) * many)
            own = words.take(pa.array(pairs % max(1, many)))
            rare = pa.StructArray.from_arrays([own, pa.array(tf.astype(np.int32))], names=["word", "tf"])
            yield pa.RecordBatch.from_pydict(
                {
                    "_row": rows["_row"],
                    "doc_id": rows["doc_id"],
                    "held_out": rows["held_out"],
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "n_known": np.add.reduceat((memory.count > 0)[met].astype(np.int64), starts),
                    "log_sum": np.add.reduceat(logs[met], starts),
                    "ids": _packed(ids, id_ends),
                    "rare": pa.ListArray.from_arrays(rare_ends.astype(np.int32), rare),
                    "_round": rows["_round"],
                }
            )

    return run


def _packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids as bytes, a value for each text."""
    offsets = (np.concatenate(([0], ends)) * ids.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())


def _id_counter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in _listed(batches, size):
            total += np.bincount(batch["ids"].flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen.astype(np.int32), "n": total[seen]})

    return run


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their ids, and where the ids of each row end, in runs of about RUN_IDS (one text aside).

    A run goes on over the border of two batches, so runs do not depend on how rows are batched.
    """
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        at = batch["ids"].offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + RUN_IDS, side="right")) - 1)
            if stop == batch.num_rows and at[stop] - at[start] < RUN_IDS:
                break
            yield _id_run(batch, at, start, stop)
            start = stop
        rest = batch.slice(start) if start < batch.num_rows else None
    if rest is not None:
        yield _id_run(rest, rest["ids"].offsets.to_numpy().astype(np.int64), 0, rest.num_rows)


def _id_run(batch: pa.RecordBatch, at: np.ndarray, start: int, stop: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    part = batch.slice(start, stop - start)
    return part, part["ids"].flatten().to_numpy(), at[start + 1 : stop + 1] - at[start]


TRAINED = "shard long, block int, means binary, weights binary"


def _as_rows(shard: int, block: int, means: np.ndarray, weights: np.ndarray) -> dict:
    return {
        "shard": [shard],
        "block": pa.array([block], pa.int32()),
        "means": [means.astype(np.float32).tobytes()],
        "weights": [weights.astype(np.float32).tobytes()],
    }


def _trainer(vocabulary: Broadcast, theta: Broadcast, rate: float):
    """One pass over a task's texts from the parameters ``theta``; the outcome in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(vocabulary.value, theta.value.copy())
        grad, adam = Attention(vocabulary.value, np.zeros_like(model.theta)), Adam(len(model.theta), rate)
        n, met = len(vocabulary.value), np.zeros(len(vocabulary.value), dtype=np.int64)
        n_texts = 0
        for _, ids, ends in _id_runs(_listed(batches, len(vocabulary.value.place_of))):
            places = vocabulary.value.place_of[ids]
            met += np.bincount(places, minlength=n)
            n_texts += len(ends)
            for inputs, wanted, targets, _ in windows(places, ends, n, WINDOW, STEP_WINDOWS):
                learn(model, grad, adam, inputs, wanted, targets)
        if not n_texts:
            return
        # How often a parameter was met: an embedding with its id, a member with its group.
        weights = Attention(vocabulary.value, np.full(len(model.theta), met.sum(), dtype=np.float32))
        weights["embed"][...] = np.append(met, n_texts)[:, None]
        cuts = vocabulary.value.cuts
        weights["member"][...] = np.repeat(np.add.reduceat(met, cuts[:-1]), np.diff(cuts))[:, None]
        shard = TaskContext.get().partitionId()
        for block, at in enumerate(range(0, len(model.theta), BLOCK)):
            rows = _as_rows(shard, block, model.theta[at : at + BLOCK], weights.theta[at : at + BLOCK])
            yield pa.RecordBatch.from_pydict(rows)

    return run


def _average(key: tuple, rows: pa.Table) -> pa.Table:
    """Weighted means of one block; what nobody has met stays 0 with weight 0."""
    total, weight = 0.0, 0.0
    order = np.argsort(rows["shard"].to_numpy(), kind="stable").tolist()  # the same sum in every run
    means, weights = rows["means"].to_pylist(), rows["weights"].to_pylist()
    for k in order:
        w = np.frombuffer(weights[k], np.float32).astype(np.float64)
        total = total + w * np.frombuffer(means[k], np.float32)
        weight = weight + w
    return pa.table(_as_rows(key[0].as_py(), key[1].as_py(), total / np.maximum(weight, 1e-30), weight))


def _averaged(trained: DataFrame, theta: np.ndarray) -> np.ndarray:
    """The mean of the tasks' parameters, in a tree in which a task meets FAN_IN of a block at most."""
    shards = trained.agg(F.max("shard")).first()[0]
    while shards:
        parent = F.shiftright("shard", FAN_IN.bit_length() - 1)
        trained = trained.groupBy(parent.alias("_parent"), "block").applyInArrow(_average, TRAINED)
        shards >>= FAN_IN.bit_length() - 1
    out = theta.copy()
    for row in trained.toArrow().to_pylist():
        part = out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK]
        weights = np.frombuffer(row["weights"], np.float32)
        part[weights > 0] = np.frombuffer(row["means"], np.float32)[weights > 0]
    return out


def train(coded: DataFrame, size: int, folder: str, rates: tuple[float, ...] = RATES) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and parameters from the rows of ``coded`` (ids, _round) whose _round is 0 or more."""
    context = coded.sparkSession.sparkContext
    learned = coded.filter("_round >= 0").select("ids")
    seen = learned.mapInArrow(_id_counter(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    vocabulary = Vocabulary.of(seen["id"].to_numpy(), seen["n"].to_numpy(), size)
    theta, known = Attention(vocabulary).theta, context.broadcast(vocabulary)
    for turn, rate in enumerate(rates):
        step = _trainer(known, context.broadcast(theta), rate)
        texts = coded.filter(F.col("_round") == turn).select("ids")
        texts.mapInArrow(step, TRAINED).write.parquet(f"{folder}/trained-{turn}")
        theta = _averaged(coded.sparkSession.read.parquet(f"{folder}/trained-{turn}"), theta)
    return vocabulary, theta


def _scorer(vocabulary: Broadcast, theta: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(vocabulary.value, theta.value)
        for part, ids, ends in _id_runs(_listed(batches, len(vocabulary.value.place_of))):
            places, score = vocabulary.value.place_of[ids], np.zeros(len(ends))
            for inputs, wanted, targets, text in windows(places, ends, len(vocabulary.value), STRIDE, SCORE_WINDOWS):
                log_p = model.log_probabilities(inputs, wanted, targets)
                score += np.bincount(text, weights=log_p, minlength=len(ends))
            columns = {name: part[name] for name in part.schema.names if name != "ids"}
            yield pa.RecordBatch.from_pydict({**columns, "score": score / math.log(10)})

    return run


def lm_scores(
    docs: DataFrame, held_out: Column, ranks: str, pattern: str, rates: tuple[float, ...] = RATES
) -> DataFrame:
    """Two log10 probabilities of every whole text of ``docs`` (doc_id, text), learned from rows not ``held_out``.

    Tokens are the words between white space, A-Z lower-cased, and one end.  Returns doc_id,
    held_out, n_tokens, n_known (tokens that training texts hold), train_tokens, base_score
    (word counts with one added, and one more word for all unknown ones) and score (the attention
    model's, over the byte-level ids of each word and the end).

    A null text is empty, which is an end alone; texts are learned and scored whole, windows overlap
    and score each id once.  ``ranks`` is a tokenizer's file of ranks, which every machine has, and
    ``pattern`` its pattern.  A null ``held_out`` is false, doc_id is a long, of which rows may
    repeat: each is a row.  Other columns are left out, an empty table gives an empty one.  Without
    training texts every token has probability 1 for the base, and ids are equally likely.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "language-model")
    small_batches(spark)
    texts = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    learned = texts.filter("not held_out")
    counts = materialise(word_counts(learned))
    n_train = learned.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)
    is_hot = (F.col("c") * HOT_WORDS >= total) & (F.octet_length("word") <= HOT_BYTES)
    hot = {bytes(row.word): row.c for row in counts.filter(is_hot).collect()}

    turn = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("_row", "text"), F.lit(len(rates)))).cast("int")
    coder = _encoder(ranks, pattern, spark.sparkContext.broadcast(hot), n_train)
    rounds = texts.select("_row", "doc_id", "held_out", turn.alias("_round"), "text")
    rounds.mapInArrow(coder, CODED).write.option("compression", "zstd").parquet(f"{folder}/coded")
    coded = spark.read.schema(CODED).parquet(f"{folder}/coded")

    size = _tokenizer(ranks, pattern).n_vocab + 1
    vocabulary, theta = train(coded, size, folder, rates)
    score = _scorer(spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(theta))
    kept = "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double"
    scored = coded.select("_row", "doc_id", "held_out", "n_tokens", "n_known", "log_sum", "ids").mapInArrow(
        score, f"{kept}, score double"
    )
    rare = coded.select("_row", F.explode("rare").alias("_w")).select("_row", "_w.word", "_w.tf")
    sums = (
        rare.join(counts.filter(~is_hot).hint("shuffle_hash"), "word")
        .groupBy("_row")
        .agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("_sum"), F.sum("tf").alias("_known"))
    )
    base = F.col("log_sum") + F.coalesce("_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)
    return scored.join(sums, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
