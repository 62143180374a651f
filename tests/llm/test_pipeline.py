"""The stages of the pipeline, each on what its predecessor kept."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from faultline.llm.common import table
from faultline.llm.simhash import simhash_groups
from tests.llm.test_line_dedup import brute as dedup_lines

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return len((text or "").encode().split())


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], table(spark, SF_DIR, "documents")
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, steps):
    toxic = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in steps[0]} - {r.doc_id for r in steps[1]}
    assert gone & toxic and len(gone - toxic) < 0.1 * len(steps[0])
    assert {r.doc_id: r for r in steps[0]} | {r.doc_id: r for r in steps[1]} == {r.doc_id: r for r in steps[0]}


def test_repeated_lines_go(steps):
    want = dedup_lines([(r.doc_id, r.text) for r in steps[1]])
    assert sorted([(r.doc_id, r.text or "") for r in steps[2]], key=str) == sorted([(w[0], w[3]) for w in want], key=str)
    assert all(r.n_chars == len(r.text or "") for r in steps[2])


def test_one_of_each_group_stays(spark, steps):
    kept = {r.doc_id for r in steps[3]}
    assert Counter(steps[3]) == Counter(r for r in steps[2] if r.doc_id in kept)
    docs = spark.createDataFrame(steps[2], "doc_id long, text string, lang string, source string, n_chars long")
    assert kept == {r.component_id for r in simhash_groups(docs).collect()}
    assert len(kept) < len(steps[2])


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted double, "
ODD += "n_lines int, n_dropped string, shard string, slot string, fp string, _doc long, _least string, first date"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, names that operators use."""
    extra = ("0.5", 0.25, 7, "x", "9", "s", "f", 1, "l", None)
    lines = ["A line that several documents hold, word for word", "another line"]
    rows = [(i, f"{lines[0]}\nown words of document {i} {i * 7} {i * 13}", "en", "s", 60, *extra) for i in range(8)]
    rows += [(9, "word " * 50_000, None, None, None, *extra), (10, None, None, None, None, *[None] * 10)]
    rows += [(11, "", "en", "s", 0, *extra), (11, "", "en", "s", 0, *extra), (None, "nobody's text is here", "en", "t", 21, *extra)]
    return rows + [(None, "nobody's text is here", "en", "t", 21, *extra), rows[3], rows[3]]


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_the_other_columns(spark, stage):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, SF_DIR)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    own = ("doc_id", "text", "n_chars")
    whole = {tuple(v for c, v in r.asDict().items() if c not in own) + (r.doc_id,) for r in docs.collect()}
    rows = got.collect()
    assert {tuple(v for c, v in r.asDict().items() if c not in own) + (r.doc_id,) for r in rows} <= whole
    if name == "line_dedup":
        assert len(rows) == docs.count()
        holders = [r.doc_id for r in rows if "several documents hold" in (r.text or "")]
        assert set(holders) == {7}
    if name == "near_dups":
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and {9, 10, None} <= set(ids) and 11 not in ids
    if name in ("toxicity", "near_dups"):
        assert set(rows) <= set(docs.collect())
    assert run(spark, docs.limit(0), SF_DIR).collect() == []


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    got = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR)
    assert sum(r.n_words for r in got.collect()) == sum(words(r[1]) for r in odd_rows())
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF_DIR).collect() == []


def test_mix_has_the_size_of_its_input(steps):
    before, after = sum(words(r.text) for r in steps[3]), sum(words(r.text) for r in steps[4])
    assert abs(after - before) < 0.05 * before
    taken, size = Counter(), {}
    for r in steps[4]:
        taken[r.doc_id] += words(r.text)
    for r in steps[3]:
        size[r.doc_id] = words(r.text)
    assert all(taken[i] <= 3 * size[i] for i in taken)
    assert all(r.n_chars == len(r.text) for r in steps[4])


def test_everything_is_packed(steps):
    assert sum(r.n_words for r in steps[5]) == sum(words(r.text) for r in steps[4])
    assert Counter(r.doc_id for r in steps[5]) == Counter(r.doc_id for r in steps[4])
    room, sources, held = defaultdict(int), {r.doc_id: r.source for r in steps[4]}, defaultdict(list)
    for r in steps[5]:
        room[r.bin_id] += r.n_words
        held[r.bin_id].append(sources[r.doc_id])
    assert max(room.values()) <= 2048
    assert all(len(h) == len(set(h)) for h in held.values())


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(got.collect()) == Counter(steps[-1])
