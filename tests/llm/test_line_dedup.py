"""Line deduplication against a dictionary of lines, and the hash it probes."""

from __future__ import annotations

import random
import time

import numpy as np

from faultline.llm.line_dedup import MinimalPerfectHash, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for i, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k: len(holders.get(k, ())) >= min_docs and max(holders[k]) != (-1 if i is None else i)
        kept = [x for x in lines if not gone(key_of(x))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got], key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Shared line number {k} of the pool" for k in range(60)] + ["short", "", "x" * 19, "ü" * 20, "y" * 20]
    rows = []
    for i in range(400):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + [f"own line of document {i} {j}" for j in range(2)]
        if i % 3 == 0:
            lines.append("  The one line that a third of them HOLD \t")
        rng.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "word " * 60_000), (None, "y" * 20), (None, pool[0])]
    rows += [(7, rows[7][1])]  # a repeated row
    assert run(spark, rows) == brute(rows)


def test_one_key_in_many_spellings(spark):
    rows = [(i, "\r The same old line of text\x0b".upper() if i % 2 else "the same old line of text") for i in range(5)]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 1, 1, 1, 0] and got[4][3] == rows[4][1]


def test_empty_and_clashing(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(i, "a line that is long enough", "z", 1, 2) for i in range(3)], "doc_id long, text string, n_lines string, h1 long, _lost int")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "h1", "_lost", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got.collect()) == [(0, "", 1), (1, "", 1), (2, "a line that is long enough", 0)]


def test_all_keepers_null(spark):
    rows = [(None, "a line that is long enough")] * 4
    assert run(spark, rows) == brute(rows)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
        assert sorted(h.slots(keys)) == list(range(len(keys)))
        if n >= 1000:
            assert 8 * len(h.to_bytes()) < 4 * n + 64 * 40


def test_many_lines_take_no_square(spark):
    """Three texts of 200,000 lines, half of them shared and repeated."""
    shared = [f"shared line number {k} of the long texts" for k in range(50_000)]
    rows = [(i, "\n".join(shared + [f"own line {i} {k} of a long text" for k in range(100_000)] + shared)) for i in range(3)]
    start = time.time()
    got = run(spark, rows)
    assert [r[1:3] for r in got] == [(200_000, 100_000), (200_000, 100_000), (200_000, 0)]
    assert time.time() - start < 90
