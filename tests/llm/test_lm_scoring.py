"""Word counts against plain Python; the attention model against its definition, and what it learns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import lm_scoring
from faultline.llm.attention import SCORE_WINDOWS, STRIDE, WINDOW, Attention, Vocabulary, windows
from faultline.llm.lm_scoring import lm_scores
from faultline.llm.queries import op13_lm_scoring

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = (str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def words_of(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def brute_base(rows):
    tokens = [[*words_of(text), None] for _, text in rows]
    counts = Counter(t for (doc_id, _), own in zip(rows, tokens) if not held_out(doc_id) for t in own)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (
            doc_id,
            held_out(doc_id),
            len(own),
            sum(counts[t] > 0 for t in own),
            total,
            sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own),
        )
        for (doc_id, _), own in zip(rows, tokens)
    ]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def grammar(rng, n):
    """Texts whose words follow one another by a rule, and each other text shuffled."""
    names = "the of and to in is you that it he was for on are as with his they at be this have from or one had by".split()
    for i in range(n):
        at, text = rng.randrange(len(names)), []
        for _ in range(rng.choice([5, 30, 120])):
            text.append(names[at].upper() if rng.random() < 0.1 else names[at])
            at = (at * 7 + rng.choice([1, 2])) % len(names)
        if i % 2:
            rng.shuffle(text)
        yield i, " ".join(text)


def test_base_on_odd_rows(spark):
    rows = list(grammar(random.Random(3), 700))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "Word1  x\x0bword2 <|endoftext|>"), (None, None)]
    rows += [(1003, "only here " * 20_000), (1004, "x" * 100_000), (1005, "日本 " * 50), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, _row int")
    got = sorted_rows([tuple(r) for r in lm_scores(docs.repartition(3), held(), *TOKENIZER).collect()])
    want = sorted_rows(brute_base(rows))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] < 0 and math.isfinite(g[6])


def test_learns_more_than_counts(spark):
    """Held-out texts that follow the rule are likelier than shuffled ones, for the model alone."""
    rows = list(grammar(random.Random(9), 3000))
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), held(), *TOKENIZER).collect()
    rate = {r.doc_id: (r.score / r.n_tokens, r.base_score / r.n_tokens) for r in got if r.held_out and r.n_tokens > 20}
    ruled, shuffled = ([v for k, v in rate.items() if k % 2 == side] for side in (0, 1))
    model, base = (np.mean([v[i] for v in ruled]) - np.mean([v[i] for v in shuffled]) for i in (0, 1))
    assert model > 0.3 and abs(base) < 0.05
    assert np.mean([v[0] for v in ruled]) > np.mean([v[1] for v in ruled]) + 0.2


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 20)  # nearly all words go through the join
    rows = list(grammar(random.Random(4), 60))
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), held(), *TOKENIZER, rates=(0.01,)).collect()
    for g, w in zip(sorted_rows([tuple(r) for r in got]), sorted_rows(brute_base(rows))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_empty_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(empty, held(), *TOKENIZER).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in lm_scores(docs, F.lit(True), *TOKENIZER).collect())
    assert [g[:6] for g in got] == [(1, True, 3, 0, 0, 0.0), (2, True, 1, 0, 0, 0.0)]
    assert got[1][6] == pytest.approx(-math.log10(50257), rel=1e-3) and got[0][6] == pytest.approx(3 * got[1][6], rel=1e-3)


def test_query_runs_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = op13_lm_scoring(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for g, w in zip(sorted_rows([tuple(r) for r in got]), sorted_rows(brute_base(rows)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    vocabulary = Vocabulary.of(np.arange(5, 65), rng.integers(1, 1000, 60), 80)
    model = Attention(vocabulary)
    model.theta += rng.normal(0, 0.1, len(model.theta)).astype(np.float32)
    return model


def scores_of(model, texts, size=SCORE_WINDOWS):
    places, ends = model.vocabulary.place_of[np.concatenate(texts)], np.cumsum([len(t) for t in texts])
    out = [[] for _ in texts]
    for inputs, wanted, targets, text in windows(places, ends, len(model.vocabulary), STRIDE, size):
        for k, p in zip(text, model.log_probabilities(inputs, wanted, targets)):
            out[k].append(p)
    return out


def test_probabilities_add_up(model):
    inputs = np.tile(np.concatenate(([len(model.vocabulary)], np.arange(WINDOW - 1))), (80, 1))
    wanted = np.zeros(inputs.shape, dtype=bool)
    wanted[:, 9] = True
    ids = np.arange(80)
    p = np.exp(model.log_probabilities(inputs, wanted, model.vocabulary.place_of[ids]))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_windows_score_each_id_once_and_look_back_only(model):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 80, n) for n in (1, 2, WINDOW, WINDOW + 1, 25, 500, WINDOW + STRIDE)]
    together = scores_of(model, texts)
    assert [len(s) for s in together] == [len(t) for t in texts]
    for k, text in enumerate(texts):
        assert np.allclose(scores_of(model, [text], 3)[0], together[k], atol=1e-4)
    longer = scores_of(model, [np.concatenate((texts[2], texts[3]))])[0]
    assert np.allclose(longer[: len(texts[2])], together[2], atol=1e-4)


def test_gradient_is_the_slope_of_the_loss(model):
    rng = np.random.default_rng(3)
    places = model.vocabulary.place_of[rng.integers(5, 65, 200)]
    inputs, wanted, targets, _ = next(windows(places, np.array([70, 200]), len(model.vocabulary), WINDOW, 100))
    grad, start = Attention(model.vocabulary, np.zeros_like(model.theta)), model.theta.copy()
    model.gradient(inputs, wanted, targets, grad)
    for name, (low, high, _) in model.views.items():
        step = np.zeros_like(start)
        step[low:high] = grad.theta[low:high]
        length = float(np.linalg.norm(step))
        loss = []
        for sign in (1, -1):
            model.theta[:] = start + sign * 0.02 * step / length
            loss.append(-model.log_probabilities(inputs, wanted, targets).mean())
        model.theta[:] = start
        assert (loss[0] - loss[1]) / 0.04 == pytest.approx(length, rel=0.03), name


def test_runs_do_not_depend_on_batches(monkeypatch):
    """Small batches, as memory wants them, give the runs that one large batch gives."""
    import pyarrow as pa

    from faultline.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "RUN_IDS", 10)
    ids = [[k] * (k % 7 + 1) for k in range(50)] + [[50] * 40, [51]]
    whole = pa.RecordBatch.from_pydict({"n": list(range(52)), "ids": pa.array(ids, pa.list_(pa.int32()))})

    def found(size):
        batches = (whole.slice(k, size) for k in range(0, 52, size))
        return [(p["n"].to_pylist(), i.tolist(), e.tolist()) for p, i, e in lm_scoring._id_runs(batches)]

    want = found(52)
    assert [n for run in want for n in run[0]] == list(range(52))
    assert found(1) == found(3) == found(20) == want


def test_words_are_those_of_bytes_split():
    """Runs of texts split by Arrow have the words that Python finds, in their order, with their texts."""
    import pyarrow as pa

    texts = ["", " a B\x0b\x0cc ", " \t\r\n", "É\u00a0x\u0085y\x1cz Ü", "a", "STRASSE İ  " * 3, "x" * 1000]
    for some in (texts, ["", " "], texts[1:2]):
        numbers, words, text = lm_scoring._split(pa.array(some))
        want = [(k, w) for k, own in enumerate(some) for w in words_of(own)]
        assert list(zip(text.tolist(), (words[i].as_py() for i in numbers.tolist()))) == want
        assert len(set(words.to_pylist())) == len(words)


def test_written_ids_come_back():
    import pyarrow as pa

    for size, top in ((1 << 16, 65_535), (1 << 20, 1_000_000)):
        ids = np.array([5, 0, top, 7, 1, 2], lm_scoring._id_type(size))
        packed = lm_scoring._packed(ids, np.array([2, 3, 6]))
        batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3], "ids": packed})
        batches = [batch.slice(0, 0), batch.slice(1, 2), batch]
        got = [row for b in lm_scoring._listed(batches, size) for row in b.to_pylist()]
        want = [{"n": 1, "ids": [5, 0]}, {"n": 2, "ids": [top]}, {"n": 3, "ids": [7, 1, 2]}]
        assert got == want[1:] + want


def test_steps_share_their_memory(model):
    """A step takes no new pages, and nothing of one batch is seen in the next, larger or smaller."""
    import resource

    rng = np.random.default_rng(5)
    places = model.vocabulary.place_of[rng.integers(0, 80, 40_000)]
    batches = list(windows(places, np.array([3000, 3001, 40_000]), len(model.vocabulary), WINDOW, 192))
    batches += list(windows(places, np.array([70, 40_000]), len(model.vocabulary), STRIDE, 100))
    grad = Attention(model.vocabulary, np.zeros_like(model.theta))
    own = Attention(model.vocabulary, model.theta.copy())
    for inputs, wanted, targets, _ in batches * 2:
        fresh = Attention(model.vocabulary, model.theta.copy())
        other = Attention(model.vocabulary, np.zeros_like(model.theta))
        assert own.gradient(inputs, wanted, targets, grad) == fresh.gradient(inputs, wanted, targets, other)
        assert np.array_equal(grad.theta, other.theta)
        log_p = own.log_probabilities(inputs, wanted, targets)
        assert np.array_equal(log_p, fresh.log_probabilities(inputs, wanted, targets))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(10):
        own.gradient(*batches[0][:3], grad)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 10 * 600
