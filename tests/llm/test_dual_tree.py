"""Dual-tree search against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import dual_tree
from faultline.llm.dual_tree import CoverTree, dual_search, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for i, q in fine:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=10, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = top_k(df, F.col("vec_id") % every == 0, k, **settings).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_cover_tree_covers(monkeypatch):
    monkeypatch.setattr(dual_tree, "LEAF", 8)
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(1, 6)), 100, axis=0)))
    tree = CoverTree(points)
    assert sorted(tree.order) == list(range(600))
    for i in range(len(tree.centre)):
        own = tree.points[tree.order[tree.first[i] : tree.end[i]]]
        assert np.linalg.norm(own - tree.centre[i], axis=1).max() <= tree.radius[i] + 1e-9
        if tree.children[i]:
            spans = [(tree.first[c], tree.end[c]) for c in tree.children[i]]
            assert spans[0][0] == tree.first[i] and spans[-1][1] == tree.end[i]


def test_pruning_keeps_the_best(monkeypatch):
    monkeypatch.setattr(dual_tree, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (12, 5))
    data = centres[rng.integers(0, 12, 3000)] + rng.integers(-4, 5, (3000, 5))
    queries, ids = data[:60], rng.permutation(3000)
    offered = []
    offer = dual_tree.Best.offer
    monkeypatch.setattr(dual_tree.Best, "offer", lambda self, r, s, i: (offered.append(s.size), offer(self, r, s, i)))
    best = dual_search(queries, data, ids, 6, np.full(60, dual_tree.NOTHING))
    for q in range(60):
        scores = data @ queries[q]
        want = np.lexsort((ids, -scores))[:6]
        assert list(best.ids[q]) == list(ids[want]) and list(best.scores[q]) == list(scores[want])
    assert sum(offered) < 0.5 * 60 * 3000  # pruned, not compared


def test_large_integers_are_exact():
    rng = np.random.default_rng(3)
    data = rng.integers(-(2**29), 2**29, (300, 4))
    best = dual_search(data[:5], data, np.arange(300), 3, np.full(5, dual_tree.NOTHING))
    want = data.astype(object) @ data[:5].T.astype(object)
    assert [list(best.scores[q]) for q in range(5)] == [sorted(want[:, q], reverse=True)[:3] for q in range(5)]


@pytest.mark.parametrize("block_rows", [50, 100_000])
def test_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 480)]  # one common vector
    rows += [(500, None), (510, [0.1, None]), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(540, []), (550, [0.3, 0.3]), (0, rows[0][1]), (10, [0.25] * 8)]
    assert run(spark, rows, block_rows=block_rows) == brute(rows, 5, 10)


def test_a_task_holds_a_part_of_the_queries(spark, monkeypatch):
    search = dual_tree._searcher

    def watched(k):
        inner = search(k)

        def run_block(data, queries):
            assert queries.num_rows <= 300, queries.num_rows
            return inner(data, queries)

        return run_block

    monkeypatch.setattr(dual_tree, "_searcher", watched)
    monkeypatch.setattr(dual_tree, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(1000)]
    assert run(spark, rows, every=1, block_rows=100) == brute(rows, 5, 1)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5, 10) and len(run(spark, rows)) == 4
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 7, 8, 9), (1, [2.0], 7, 8, 9)], SCHEMA + ", query long, vector long, rank int")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 131072)]


def test_queries_are_sent_to_few_blocks(spark, monkeypatch):
    """Clustered vectors: under a tenth of all pairs of a query and a block are sent, with the same result."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 8
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=8) / 20]) for i in range(4000)]
    sent, plain = [], dual_tree.visits

    def counted(home, floors, placed):
        out = dual_tree.materialise(plain(home, floors, placed))
        sent.append((out.count(), home.count() * (placed.select("block").distinct().count() - 1)))
        return out

    monkeypatch.setattr(dual_tree, "visits", counted)
    assert run(spark, rows, every=20, block_rows=100) == brute(rows, 5, 20)
    ((got, every),) = sent
    assert got < every / 10
