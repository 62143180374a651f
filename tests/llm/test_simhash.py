"""Fingerprints by their definition, and the search against all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from faultline.llm.simhash import (
    MASKS,
    _roots,
    fingerprint,
    grow,
    link_fingerprints,
    pairs_within,
    shingle_hashes,
    simhash_groups,
    visits,
)


def plain_fingerprint(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    parts = [p for p in low.split(" ") if p]
    if not parts:
        return "0" * 16
    runs = [parts[i : i + words] for i in range(len(parts) - words + 1)] or [parts]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def groups_of(values, radius):
    """{value: least value of its group} over all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def crowd(rng, n=900):
    """Random fingerprints, some with others near them, some in chains."""
    out = set()
    while len(out) < n:
        at = rng.getrandbits(64)
        out.add(at)
        for _ in range(rng.choice([0, 0, 0, 3, 20])):
            for _ in range(rng.choice([1, 2, 3, 4])):
                at ^= 1 << rng.randrange(64)
            out.add(at)
    return sorted(out)


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "a b c", "Ä b Ä b\x0bC", "x y z w"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (4, 10, 333)]
    for text in texts:
        got = fingerprint(shingle_hashes(None if text is None else text.encode(), 3))
        assert f"{got & 2**64 - 1:016x}" == plain_fingerprint(text), text


def test_search_finds_all_links(spark):
    values = crowd(random.Random(2))
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    for radius, size in ((3, 64), (3, 2), (5, 100), (0, 64)):  # size 2: shards are crowded and cut into parts
        links = link_fingerprints(df, radius, size).collect()
        parent = {v: v for v in values}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for r in links:
            a, b = r.a & 2**64 - 1, r.b & 2**64 - 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == groups_of(values, radius), (radius, size)


def test_triangle_bounds_lose_no_shard():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    tree, near = grow(points, MASKS[0], 6, [0]), points ^ np.uint64(1 << 5)
    home, seen = np.zeros(4000, dtype=int), [set() for _ in points]
    for shard, own in visits(tree, points, MASKS[0], 0):
        home[own] = shard
    for shard, own in visits(tree, near, MASKS[0], 1):
        for i in own:
            seen[i].add(shard)
    assert all(h in s for h, s in zip(home, seen)) and np.mean([len(s) for s in seen]) < 12


def test_pairs_in_a_shard():
    points = np.array(crowd(random.Random(4), 700), dtype=np.uint64)
    got = {(i, j) for a, b in pairs_within(points, points, MASKS[1], 1, 3) for i, j in zip(a, b)}
    x = points[:, None] ^ points[None, :]
    want = (np.bitwise_count(x) <= 3) & (np.bitwise_count(x & np.uint64(MASKS[1])) <= 1)
    assert all(bin(int(points[i] ^ points[j])).count("1") <= 3 for i, j in got)
    assert {(i, j) for i, j in zip(*np.nonzero(want))} <= got
    assert list(_roots(5, iter([(np.array([4, 3]), np.array([3, 1]))]))) == [0, 1, 2, 1, 1]


def test_groups_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(200))) for i in range(120)]
    for i in range(120, 260):
        words = rows[rng.randrange(len(rows))][1].split()
        words[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  "), (303, "zero"), (304, "ZERO"), (None, rows[5][1]), (None, "alone at last"), (5, rows[5][1])]
    rows += [(305, "long text " * 40_000)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted([(r.doc_id, r.fingerprint) for r in got], key=str) == sorted(prints, key=str)
    root = groups_of(sorted({int(p, 16) for _, p in prints}), 3)
    least = {}
    for i, p in prints:
        k = root[int(p, 16)]
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(i, least[root[int(p, 16)]]) for i, p in prints], key=str)
    assert len(set(least.values())) < 200


def test_empty_and_clashing(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a", 5, "x", 9)], "doc_id long, text string, fp long, node string, component_id long")
    assert [(r.doc_id, r.component_id) for r in simhash_groups(docs).collect()] == [(1, 1)]
