"""Token shards: the matrix against plain arrays, the encoder against the library, files there and back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import token_shards
from faultline.llm.token_shards import WaveletShard, WordEncoder, find_tokens, read_token_shards, write_token_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 513, 5000):
        ids = rng.choice(np.array([0, 1, 5, 300, 49407], dtype=np.uint16), n)
        shard = WaveletShard.from_bytes(WaveletShard.of(ids, [1, None], np.array([n // 2, n]), 16).to_bytes())
        assert list(shard.ids()) == list(ids) and shard.doc_ids == [1, None]
        if not n:
            continue
        places = rng.integers(0, n, 50)
        assert list(shard.access(places)) == list(ids[places])
        for token in (0, 1, 5, 7, 300, 49407, 70000):
            where = np.flatnonzero(ids == token)
            assert shard.count(token) == len(where)
            assert shard.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
            assert list(shard.occurrences(token)) == list(where)
            assert list(shard.occurrences(token, 2, 3)) == list(where[2:5])


def test_encoder_is_the_library(monkeypatch):
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(33, 256)] + list("aeiou'śΣςİЖ中  \x1c\x85😀 \n\t")
    words = ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(4000)]
    words += ["<|endoftext|>", "a<|endoftext|>b", "don't", "''s", "'S", "ＡＢ", "ÀÉß", "x" * 5000, "ΑΣ", "İ", "é"]
    for bound in (1 << 19, 10):  # with a full memory too
        monkeypatch.setattr(token_shards, "REMEMBERED", bound)
        encoder = WordEncoder(PATH)
        for k in range(0, len(words), 40):
            text = rng.choice([" ", "\n", "\x0b \t"]).join(words[k : k + 40])
            assert list(encoder.encode(text.encode())) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_are_encoded_together_and_a_word_is_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, word):
            Counting.asked += 1
            return super().get(word)

    rng = random.Random(4)
    texts = ["", " \x0b", *(" ".join(rng.choice(["The", "cat's", "ÜBER", "中x", "42"]) for _ in range(rng.randrange(300))) for _ in range(50))]
    texts.append("\tÀ\x1cb\x85c  ")
    encoder = WordEncoder(PATH)
    encoder.words = Counting()
    ids, ends = encoder.encode_all(pa.array(texts), np.array([1], encoder.dtype).tobytes())
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [list(i) for i in np.split(ids, ends[:-1])] == want and ends[-1] == len(ids)
    assert Counting.asked <= 8


def test_shards_end_with_the_document_that_fills_them(spark, tmp_path):
    rows = [(i, "a " * n) for i, n in enumerate([1, 5, 0, 9, 3, 25, 2, 4, 4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        shards = write_token_shards(docs, f"file://{tmp_path}/full", PATH, shard_ids=10).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [(r.docs, r.ids, r.start) for r in shards] == [(4, 19, 0), (2, 30, 19), (3, 13, 49)]


def test_there_and_back(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["The", "stupid", "cat's", "ÜBER", "42", "x,y"]) for _ in range(rng.randrange(60)))) for i in range(500)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "Long words " * 30_000), (None, "no id"), (3, rows[3][1])]
    rng.shuffle(rows)
    folder = f"file://{tmp_path}/ids"
    shards = write_token_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, PATH, shard_ids=3000)
    got = sorted(read_token_shards(shards, folder).collect(), key=lambda r: r.start)
    assert shards.count() > 4
    tokenizer, start, places = WordEncoder(PATH).tokenizer, 0, []
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    text_of = dict(rows)
    for r in got:
        ids = [*tokenizer.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        places += [(start + k, r.doc_id) for k, t in enumerate(ids) if t == 1]
        start += len(ids)
    found = find_tokens(shards, folder, [1]).collect()
    assert sorted(((r.place, r.doc_id) for r in found)) == places


def test_empty_and_clashing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    shards = write_token_shards(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert read_token_shards(shards, folder).collect() == []
    docs = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, start int, _same int")
    folder = f"file://{tmp_path}/one"
    assert read_token_shards(write_token_shards(docs, folder, PATH), folder).count() == 1
