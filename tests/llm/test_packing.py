"""Packing against a search of every bin."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from faultline.llm.packing import best_fit_packing, pack

SCHEMA = "doc_id long, text string, source string"


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [
            (b["room"], i)
            for i, b in enumerate(bins)
            if b["room"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(1)
    for trial in range(40):
        n = rng.randrange(1, 200)
        sizes = sorted((rng.choice([0, 1, 7, 50, 99, 100, rng.randrange(101)]) for _ in range(n)), reverse=trial % 2 == 0)
        sources = [rng.choice([-1, 0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(n)]
        clusters = [rng.choice([-1, -1, 0, 0, i + 1]) for i in range(n)]
        assert list(zip(*pack(sizes, sources, clusters, 100))) == brute(sizes, sources, clusters, 100)
    assert pack([], [], [], 10) == ([], [])


def documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.randrange(80)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    rows += [(i, "One copied text of six words", f"c{i % 40}") for i in range(1000, 1300)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "long " * 1000, None), (None, "no id", "s2"), (3, rows[3][1], "s2"), (3, rows[3][1], "s2")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_bins_hold_what_they_may(spark):
    rows, docs = documents(spark)
    got = best_fit_packing(docs.repartition(5), capacity=100, shard_pieces=200).collect()
    want = Counter()
    for i, text, _ in rows:
        n = len((text or "").encode().split())
        want.update((i, k, min(100, n - 100 * k)) for k in range(max(1, -(-n // 100))))
    assert Counter((r.doc_id, r.piece, r.n_words) for r in got) == want
    sources, texts = {i: s for i, _, s in rows}, {i: (t or "").lower() for i, t, _ in rows}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: (r.bin_offset, r.n_words))
        at = 0
        for r in pieces:
            assert r.bin_offset == at
            at += r.n_words
        assert at <= 100
        held = [sources[r.doc_id] for r in pieces if sources[r.doc_id] and r.doc_id != 3]
        assert len(held) == len(set(held))
        copies = [texts[r.doc_id] for r in pieces if texts[r.doc_id]]
        assert len(copies) == len(set(copies))
    again = best_fit_packing(docs.repartition(3), capacity=100, shard_pieces=200).collect()
    assert Counter(got) == Counter(again)


def test_given_clusters(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (2, "c d", "y", 7), (3, "e f", "z", None)], SCHEMA + ", group int")
    got = {r.doc_id: r.bin_id for r in best_fit_packing(docs, capacity=10, cluster="group").collect()}
    assert got[1] != got[2] and got[3] in (got[1], got[2])


def test_empty_and_clashing(spark):
    assert best_fit_packing(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a", "s", 3, "p", 4)], SCHEMA + ", piece int, bin_id string, _cluster int")
    assert [tuple(r) for r in best_fit_packing(docs).collect()] == [(1, 0, 1, "0-0", 0)]
