"""Targets, draws and permutations of the mix."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import mixing
from faultline.llm.mixing import Mix, mix_sources, permuted, shard_counts, water_fill

SCHEMA = "doc_id long, text string, source string"


def test_water_fill():
    assert water_fill([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    got = water_fill([10, 1000, 100, 0], [5, 2, 1, 5], 3)
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(1110) and got[2] == 300
    assert water_fill([], [], 3) == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, 7)) == list(range(n))
    assert list(permuted(np.arange(1000), 1000, 7)) != list(permuted(np.arange(1000), 1000, 8))


def test_shards_add_up():
    totals = [500, 30, 7, 0, 1263]
    sums, laps = np.zeros(5, dtype=int), []
    for shard in range(18):
        before, here = shard_counts(totals, shard, 100, 1)
        assert list(before) == list(sums) and here.sum() == 100
        sums += here
        laps.append(here[0])
    assert list(sums) == totals and np.std(laps) > 1  # a draw, not a fixed share


def test_large_draws_stay_in_range():
    totals = [5 * 10**9, 2 * 10**9, 3]
    before, here = shard_counts(totals, 12345, 4096, 1)
    assert here.sum() == 4096 and (here >= 0).all() and abs(before[0] / before.sum() - 5 / 7) < 0.01


def documents(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(i % 90)), None if i % 7 == 0 else f"s{i % 5}") for i in range(700)]
    rows += [(1, rows[1][1], rows[1][2]), (None, "null\x0bid x doc", "s1"), (900, None, "s2"), (901, " \t\n", "")]
    rows += [(902, "long " * 30_000, "s3")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_taken_meets_targets(spark):
    rows, docs = documents(spark)
    got = Mix(docs, block_words=16, shard_slots=256).taken().collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_fill([sizes[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source_size, r.target] += r.taken
    for s in names:
        assert abs(taken[sizes[s], want[s]] - want[s]) <= 0.01 * want[s] + 32, s
    again = Mix(docs.repartition(3), block_words=16, shard_slots=256).taken().collect()
    assert Counter(got) == Counter(again)


def test_mixed_pieces_are_what_was_taken(spark):
    rows, docs = documents(spark)
    taken = Counter()
    for r in Mix(docs, block_words=16, shard_slots=256).taken().collect():
        taken[r.doc_id] += r.taken
    pieces = mix_sources(docs, block_words=16, shard_slots=256).collect()
    words = Counter()
    for r in pieces:
        words[r.doc_id] += len(r.text.encode().split())
    assert words == +taken
    known = {w for _, t, _ in rows for w in (t or "").encode().split()}
    assert all(w in known for r in pieces for w in r.text.encode().split())
    per_slot = Counter()
    for r in pieces:
        per_slot[r.shard, r.slot] += len(r.text.encode().split())
    assert max(per_slot.values()) == 16 and sorted(per_slot.values())[len(per_slot) // 50] == 16


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Mix(empty).taken().collect() == [] and mix_sources(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "s", 5, "x", 3, 4, 5)], SCHEMA + ", size int, target string, shard int, first int, _nth int")
    assert [tuple(r) for r in Mix(docs).taken().collect()] == [(1, 2, 2, 2.0, 2)]
    got = mix_sources(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "target", "first", "_nth", "shard", "slot"] and got.count() == 1


def test_one_document_in_several_sources(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "t"), (1, text, None), (1, text, "t")], SCHEMA)
    words = Counter()
    for r in mix_sources(docs, block_words=16, weights=(1, 1, 1)).collect():
        words[r.source] += len(r.text.split())
    assert set(words) == {"s", "t", None} and min(words.values()) >= 30


def test_taken_again_word_by_word(spark):
    """Every slot's block, and every word of a block counted for its document, in plain loops."""
    rows, docs = documents(spark)
    mix = Mix(docs, block_words=16, shard_slots=256)
    want, spans = Counter(), mix.spans.collect()
    for s in mix.sources:
        uses = Counter()
        for i in range(s.slots):
            lap, place = divmod(i, s.blocks)
            key = int(np.random.SeedSequence([42, s.number, lap]).generate_state(1, np.uint64)[0])
            uses[int(permuted(np.array([place]), s.blocks, key)[0])] += 1
        assert all(1 <= -(-s.slots // s.blocks) - n + 1 <= 2 for n in uses.values())  # as often as any other, or once less
        own = sorted((r.start, r.size, r.doc_id) for r in spans if r.source_no == s.number)
        end = 0
        for start, size, doc_id in own:
            assert not size or start == end
            end = max(end, start + size)
            want[doc_id, size, sum(uses[w // 16] for w in range(start, start + size))] += 1
        assert end == s.words
    assert Counter((r.doc_id, r.size, r.taken) for r in mix.taken().collect()) == want
    assert len(spans) == len(rows)


def test_a_text_moves_once_however_many_pieces_it_has(spark, tmp_path, monkeypatch):
    rows, docs = documents(spark)
    cut_texts, log = mixing._cut_texts, str(tmp_path / "rows")

    def watched(names):
        cut = cut_texts(names)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(log, "a") as out:
                        out.write(f"{batch.num_rows} ")
                    yield batch

            return cut(seen())

        return run

    monkeypatch.setattr(mixing, "_cut_texts", watched)
    pieces = mix_sources(docs, block_words=16, shard_slots=256).collect()
    moved = sum(map(int, (tmp_path / "rows").read_text().split()))
    # 30,000 words are 1,875 pieces of one document.
    assert len(pieces) > 1875 and moved <= len(rows)
