"""Exact duplicates against a dictionary of texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Row

from faultline.llm.exact_dedup import exact_dedup, frequent_keys

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def lower_az(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lower_az(text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        top = max((-1 if i is None else i) for i in ids)
        for i in ids:
            sha = hashlib.sha256(text.encode()).hexdigest()
            out.append((i, None if top < 0 else top, len(ids), sha))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(i, "Same TEXT") for i in range(300)] + [(300 + i, f"text {i % 40}") for i in range(100)]
    rows += [(900, None), (901, ""), (902, "Ä"), (903, "ä"), (904, "İI"), (905, "İi"), (906, "x" * 300_000), (None, "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup(docs, counters=64).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert next(r for r in got if r.doc_id == 902).group_size == 1  # only A-Z is folded
    assert next(r for r in got if r.doc_id == 904).group_size == 2


def test_repeated_ids_keep_one_row(spark):
    docs = spark.createDataFrame([(7, "a"), (7, "A"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup(docs).collect()
    assert [r.keep_id for r in got if r.group_size == 3] == [7, 7, 7]
    assert sum(r.kept for r in got) == 2


def test_empty_and_clashing_columns(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([Row(doc_id=1, text="a", digest="x", _n=5, kept="no", keep_id=9, _key=1)])
    got = exact_dedup(docs)
    assert got.columns == COLUMNS and got.first().keep_id == 1


def test_frequent_keys_finds_heavy_ones(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, -1, if(id % 50 = 1, -2, id)) as k")
    got = [r.k for r in frequent_keys(rows.repartition(7), "k", 512).collect()]
    assert {-1, -2} <= set(got) and len(got) <= 512
