"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the terms of a text.  The
pair term lets two words say together what neither says alone, such as an insult that meets
the mention of a group.  Terms are words and the beginnings of words, hashed.

The machine is fitted on a bounded sample of the labelled rows; everything else reads all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import hash_sample

#: Labelled documents that the machine is fitted on, at most.
MOST_LABELLED = 10_000
#: Hashed terms that get weights, at most: those most unlike in toxic and clean texts.
MOST_TERMS = 4096
LEAST_RATIO = 12.0
HASH_BITS = 22
PREFIXES = (4, 5)
WORD = re.compile(r"\w+")
THRESHOLD = 0.7
#: Words whose terms a worker remembers.
REMEMBERED = 1 << 19


def hashed_terms(word: str) -> list[int]:
    """A word's terms: itself, and its first letters where it is longer."""
    named = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1) for t in named]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def text_terms(text: str | None) -> np.ndarray:
    return np.unique(np.array([t for w in words_of(text) for t in hashed_terms(w)], dtype=np.int32))


@dataclass
class Machine:
    """Weights for the hashed terms in ``terms`` (ascending); other terms have none."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, active: np.ndarray) -> float:
        """``active``: distinct places in ``terms``."""
        v = self.v[active]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.bias + float(self.w[active].sum()) + pairs

    def score(self, active: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(active), -30, 30))))


def choose_terms(rows: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """The terms that part toxic from clean texts best by the likelihood ratio, ascending.

    Terms under ``LEAST_RATIO`` may well differ by chance, and there are very many to try.
    """
    if not rows or labels.all() or not labels.any():
        return np.empty(0, dtype=np.int32)
    terms, place = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = np.repeat(labels, [len(r) for r in rows])
    seen = [np.bincount(place[toxic], minlength=len(terms)), np.bincount(place[~toxic], minlength=len(terms))]
    totals, n = [int(labels.sum()), int((~labels).sum())], len(labels)
    ratio = np.zeros(len(terms))
    for have, total in zip(seen, totals):
        for count, all_of_it in ((have, seen[0] + seen[1]), (total - have, n - seen[0] - seen[1])):
            expected = np.maximum(all_of_it * (total / n), 1e-12)
            ratio += 2 * count * np.log(np.maximum(count, 1e-12) / expected)
    best = np.lexsort((terms, -ratio))[:most]
    return np.sort(terms[best[ratio[best] >= LEAST_RATIO]])


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    most_terms: int = MOST_TERMS,
    factors: int = 8,
    passes: int = 40,
    rate: float = 0.1,
    decay: float = 2e-4,
    seed: int = 42,
) -> Machine:
    """Logistic loss, both classes of equal weight, AdaGrad over small batches.

    Without labels of both kinds the score is the smoothed share of toxic ones for every text.
    """
    terms = choose_terms(rows, labels, most_terms)
    rng, n = np.random.default_rng(seed), len(labels)
    share = (labels.sum() + 0.5) / (n + 1) if n else 0.0
    if not len(terms):
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else -30.0
        return Machine(terms, bias, np.zeros(0), np.zeros((0, factors)))
    active = [np.flatnonzero(np.isin(terms, r, assume_unique=True)) for r in rows]
    weight = np.where(labels, n / (2 * labels.sum()), n / (2 * (~labels).sum()))
    machine = Machine(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors)))
    w, v = machine.w, machine.v
    sum_w, sum_v, sum_b = np.full(len(terms), 1e-8), np.full(v.shape, 1e-8), 1e-8
    sign = np.where(labels, 1.0, -1.0)
    for _ in range(passes):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            sizes = np.array([len(active[i]) for i in batch])
            cols, doc = np.concatenate([active[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
            vc = v[cols]
            total = np.zeros((len(batch), v.shape[1]))
            np.add.at(total, doc, vc)
            square = np.bincount(doc, weights=(vc**2).sum(axis=1), minlength=len(batch))
            margin = machine.bias + np.bincount(doc, weights=w[cols], minlength=len(batch))
            margin += 0.5 * ((total**2).sum(axis=1) - square)
            pull = -sign[batch] * weight[batch] / (1 + np.exp(np.clip(sign[batch] * margin, -30, 30))) / len(batch)
            touched, place = np.unique(cols, return_inverse=True)
            gw = np.bincount(place, weights=pull[doc], minlength=len(touched)) + decay * w[touched]
            gv = np.zeros((len(touched), v.shape[1]))
            np.add.at(gv, place, pull[doc][:, None] * (total[doc] - vc))
            gv += decay * v[touched]
            sum_w[touched] += gw**2
            sum_v[touched] += gv**2
            w[touched] -= rate * gw / np.sqrt(sum_w[touched])
            v[touched] -= 0.3 * rate * gv / np.sqrt(sum_v[touched])
            gb = pull.sum()
            sum_b += gb**2
            machine.bias -= rate * gb / np.sqrt(sum_b)
    return machine


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring and never learned: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _term_lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [text_terms(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["_order"], batch["_toxic"], pa.array(lists, pa.list_(pa.int32()))], names=["_order", "_toxic", "_terms"]
        )


def fit_machine(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, **settings) -> Machine:
    """A machine from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Null labels and those without a document are left out; of several labels of a document the
    highest counts.  About ``most_labelled`` labels are taken by the hash of doc_id, never
    more: a sample that neither order nor partitions change.
    """
    usable = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("_toxic"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .withColumn("_order", F.xxhash64("doc_id"))
    )
    # The filter leaves few rows to order; the limit makes the bound hold.
    some = usable.filter(hash_sample(F.col("_order"), most_labelled, usable.count()))
    chosen = some.orderBy("_order", "doc_id").limit(most_labelled)
    # One text of a doc_id: of several the one with the smallest hash.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = met.groupBy("doc_id", "_order", "_toxic").agg(one).select("_order", "_toxic", "text")
    got = texts.mapInArrow(_term_lister, "_order long, _toxic boolean, _terms array<int>").toArrow()
    order = np.argsort(got["_order"].to_numpy(), kind="stable")
    lists = got["_terms"].combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[offsets[i] : offsets[i + 1]] for i in order]
    return fit(rows, got["_toxic"].to_numpy()[order].astype(bool), **settings)


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(t): i for i, t in enumerate(machine.terms)}
        known: dict[str, tuple] = {}

        def places(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                found = tuple(place[t] for t in hashed_terms(word) if t in place)
                if len(known) < REMEMBERED:
                    known[word] = found
            return found

        for batch in batches:
            scores = []
            for text in batch["text"].to_pylist():
                # Sorted: a sum of the same numbers in another order may differ in its last bit.
                active = sorted({i for w in words_of(text) for i in places(w)})
                scores.append(machine.score(np.array(active, dtype=np.int64)))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), from ``text`` alone.

    Null and empty texts have no terms and get the machine's bias as a score.  Columns
    named score or predicted are replaced.  Each row is scored by itself.
    """
    plain = docs.drop("score", "predicted")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    scored = plain.mapInArrow(_scorer(machine), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
