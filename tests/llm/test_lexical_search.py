"""Ranked search against scores of every document, and the bounds it prunes by."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from faultline.llm import lexical_search as search
from faultline.llm.lexical_search import _Items, _Packer, lexical_search, terms_of
from faultline.llm.queries import ORACLES, op12_lexical_search
from tests.compare import compare

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def crowd(rng, n):
    words = [f"w{k}" for k in range(400)] + ["Straße", "naïve", "日本", "ÀB", "x_y"]
    zipf = [1 / (k + 1) for k in range(len(words))]
    docs = []
    for i in range(n):
        size = rng.choice([0, 3, 20, 200, 3000 if i % 50 == 0 else 60])
        docs.append((i if i % 97 else None, " ,".join(rng.choices(words, zipf, k=size)).upper() if i % 3 else None))
    docs += [(5, "w399 w398 w397"), (5, "w399 w398 w397"), (6, "w399 w398 w397"), (7, ""), (8, "...  \n")]
    docs += [(9, "w399 " * 5000)] + [(2000 + i, "W398 w3") for i in range(120)]  # more copies than ranks
    items = [(k, " ".join(rng.choices(words, zipf, k=rng.choice([1, 5, 40])))) for k in range(30)]
    items += [(30, None), (31, ""), (32, "unheard of"), (33, "w399 w398"), (33, "w399 w398"), (33, "w2"), (None, "w7 w7 w9")]
    return docs, items


def written(spark, folder, docs, items):
    con = duckdb.connect()
    for name, schema, rows in (("documents", DOCS, docs), ("benchmark", ITEMS, items)):
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE TABLE {name} ({schema.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return con


def test_query_against_sql_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 100)  # several blocks of items
    con = written(spark, tmp_path, *crowd(random.Random(4), 900))
    name = "op12_lexical_search"
    for names in (1 << 18, 0):  # by broadcast, by shuffle
        monkeypatch.setattr(search, "BROADCAST_NAMES", names)
        assert compare(spark, con, name, op12_lexical_search, ORACLES[name], str(tmp_path)) is None


def test_bounds_hold_and_prune():
    rng = random.Random(8)
    docs, items = crowd(rng, 600)
    counted = [search.Counter(terms_of(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counted), sum(sum(c.values()) for c in counted)
    asked = [search.Counter(terms_of(t)) for _, t in items if terms_of(t)]
    df = {t: sum(t in c for c in counted) for item in asked for t in item}
    block_items, packer = _Items(asked, df, n_docs, n_terms), _Packer()
    blocks = []
    for at, counts in enumerate(counted):
        if counts:
            hashes = np.array([search._hash(t) for t in counts], dtype=np.uint64)
            blocks += packer.add(at, (0, 0), hashes, np.array(list(counts.values()), dtype=np.int64))
    blocks += packer.rest()
    seen, near, pairs = 0, 0, 0
    for block in blocks:
        bounds = block_items.bounds(block)
        for column, at in enumerate(np.frombuffer(block["docs"], np.int64)):
            exact = np.array(block_items.scores(docs[at][1], list(range(len(asked)))))
            assert (bounds[:, column] >= exact).all()
            near += int((bounds[:, column] <= 2 * exact + 1).sum())
            pairs += len(exact)
            seen += 1
    assert seen == n_docs
    assert near > 0.8 * pairs


def test_empty_and_clashing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical_search(docs, items).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "b", "y", 4)], DOCS + ", score string, item long")
    assert lexical_search(docs, items.limit(0)).collect() == []
    got = lexical_search(docs, items, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]
