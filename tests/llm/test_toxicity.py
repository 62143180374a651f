"""The factorization machine: pairs that no linear model sees, held-out rows, odd texts."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import toxicity
from faultline.llm.common import table
from faultline.llm.toxicity import fit, fit_machine, hashed_terms, score_toxicity, text_terms

SF_DIR = "/root/testdata/sf0.01"


def test_terms():
    assert len(hashed_terms("abc")) == 1 and len(hashed_terms("abcdef")) == 3
    assert list(text_terms("The the THE.")) == sorted(hashed_terms("the"))
    assert len(text_terms(None)) == len(text_terms("")) == len(text_terms(" \n.,")) == 0


def test_pairs_say_what_words_do_not():
    """Toxic if an insult meets a group, or neither is there: no sum of word weights can tell."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(2500):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = [f"plain{rng.randrange(30)}" for _ in range(6)]
        words += ["vermin" if insult else "kind", "folk" if group else "weather"]
        texts.append(" ".join(words))
        labels.append(insult == group)
    rows, labels = [text_terms(t) for t in texts], np.array(labels)

    def right(factors):
        machine = fit(rows[:2000], labels[:2000], passes=60, factors=factors)
        scores = [machine.score(np.flatnonzero(np.isin(machine.terms, r))) for r in rows[2000:]]
        return np.mean((np.array(scores) >= 0.5) == labels[2000:])

    assert right(factors=8) > 0.98 and right(factors=0) < 0.9


def test_one_class_or_none():
    rows = [text_terms("a b"), text_terms("a c")]
    for labels in ([], [True, True], [False, False]):
        machine = fit(rows[: len(labels)], np.array(labels, dtype=bool))
        assert 0 <= machine.score(np.array([], dtype=np.int64)) <= 1


def test_scores(spark):
    texts = [(i, f"you are scum {i}" if i % 4 == 0 else f"nice day today {i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(i, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(3, None), (None, 1), (9999, 1), (4, 0), (4, 1)]
    machine = fit_machine(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    again = fit_machine(docs.repartition(5), spark.createDataFrame(rows[::-1], "doc_id long, toxic int"))
    assert np.array_equal(machine.w, again.w) and machine.bias == again.bias
    odd = [(500, None), (501, ""), (502, "scum " * 50_000), (None, "Scum."), (500, None)]
    all_docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("own")).withColumn("_toxic", F.lit(1))
    scored = score_toxicity(all_docs, machine)
    assert scored.columns == ["doc_id", "text", "_toxic", "score", "predicted"]
    got = scored.collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == int("scum" in (r.text or "").lower()) for r in got)
    empty = spark.createDataFrame([], docs.schema)
    assert score_toxicity(empty, fit_machine(empty, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_rows(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = score_toxicity(docs.select("doc_id", "text"), fit_machine(docs, labels.filter(~held_out)))
    got = scored.join(labels, "doc_id").filter(held_out).select("toxic", "predicted").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.05 * len(got)


def test_a_repeated_doc_id_counts_once(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, **settings: fitted.append((len(rows), len(labels))))
    docs = [(i, f"text {i}") for i in range(20)] + [(3, "text 3")] * 50 + [(4, f"other {i}") for i in range(50)] + [(5, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    fit_machine(spark.createDataFrame(docs, "doc_id long, text string"), labels, most_labelled=20)
    assert fitted == [(20, 20)]


def test_scores_are_sums_over_terms_and_pairs(spark):
    """Every score again, term by term and pair by pair."""
    from itertools import combinations

    rng = np.random.default_rng(5)
    names = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(names, size=rng.integers(0, 15))) for _ in range(120)] + [None, "", "elsewhere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int("word3" in (t or "").split())) for i, t in enumerate(texts)], "doc_id long, toxic int"
    )
    machine = fit_machine(docs, labels)
    assert len(machine.terms)
    place = {int(t): k for k, t in enumerate(machine.terms)}
    for row in score_toxicity(docs, machine).collect():
        terms = {t for w in set((row.text or "").lower().split()) for t in hashed_terms(w)}
        mine = sorted(place[t] for t in terms if t in place)
        margin = machine.bias + sum(machine.w[i] for i in mine)
        margin += sum(float(np.dot(machine.v[i], machine.v[j])) for i, j in combinations(mine, 2))
        want = 1 / (1 + np.exp(-margin))
        assert abs(row.score - want) < 1e-9
        assert row.predicted == int(row.score >= 0.7)
