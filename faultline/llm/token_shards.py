"""Token ids in wavelet-matrix shards: one compressed file answers access, counts and occurrences.

Documents are put in ascending doc_id order, tokenized once and cut into shards.  A shard keeps
its ids as bit planes, highest bit first; each plane is stably sorted by the planes above it, so
the rank of a bit tells where an id lies in the next plane.  Following an id's bits down counts it
in any range, following them up again finds its k-th place.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import small_batches
from faultline.llm.warc import open_store
from faultline.session import materialise

MAGIC = b"WAVELET1"
#: Ids of a shard, about; a document is never cut.
SHARD_IDS = 1 << 22
#: Words and word parts whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Bytes of texts that are encoded together, about.
RUN_BYTES = 1 << 22
_BLOCK = 8  # 64-bit words for which one rank is kept


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        ones = np.add.reduceat(np.bitwise_count(words).astype(np.int64), np.arange(0, len(words), _BLOCK)) if len(words) else []
        self.before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
        self.zeros = n - int(self.before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        return cls(np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place ``i``, 0 .. n."""
        i = np.asarray(i, dtype=np.int64)
        block = i >> 9
        out = self.before[block]
        for k in range(_BLOCK):
            word = block * _BLOCK + k
            left = np.clip(i - (word << 6), 0, 64)
            some = left > 0
            if some.any():
                shift = (64 - left[some]).astype(np.uint64)
                out[some] += np.bitwise_count(self.words[word[some]] << shift).astype(np.int64)
        return out

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """Place of the k-th one (or zero), k from 0."""
        k = np.asarray(k, dtype=np.int64)
        blocks = np.arange(len(self.before), dtype=np.int64)
        counts = self.before if bit else np.minimum(blocks << 9, self.n) - self.before
        low = (np.searchsorted(counts, k, side="right") - 1) << 9
        high = np.minimum(low + (1 << 9), self.n)
        while (high - low > 1).any():  # the last place with at most k before it
            middle = (low + high) >> 1
            ones = self.rank1(middle)
            right = (ones if bit else middle - ones) <= k
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        return low


class WaveletShard:
    """Ids of some documents, in order."""

    def __init__(self, planes: list[Plane], n: int, doc_ids: list, ends: np.ndarray):
        self.planes, self.n, self.doc_ids, self.ends = planes, n, doc_ids, ends

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: list, ends: np.ndarray, width: int) -> WaveletShard:
        planes, left = [], ids
        for level in range(width - 1, -1, -1):
            bits = (left & left.dtype.type(1 << level)).astype(bool)
            planes.append(Plane.of(bits))
            after = np.empty_like(left)
            np.compress(~bits, left, out=after[: planes[-1].zeros])
            np.compress(bits, left, out=after[planes[-1].zeros :])
            left = after
        return cls(planes, len(ids), doc_ids, np.asarray(ends, dtype=np.int64))

    def ids(self) -> np.ndarray:
        """All ids, the planes undone from the last to the first."""
        out = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bits = plane.bits()
            before = np.empty_like(out)
            before[~bits] = out[: plane.zeros]
            before[bits] = out[plane.zeros :] | out.dtype.type(1 << level)
            out = before
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        i = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(i), dtype=np.uint32)
        for plane in self.planes:
            bit, ones = plane.at(i), plane.rank1(i)
            out = out << np.uint32(1) | bit.astype(np.uint32)
            i = np.where(bit, plane.zeros + ones, i - ones)
        return out

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences between two places end up below the last plane."""
        ends = np.array([start, stop], dtype=np.int64)
        if token >> len(self.planes):
            return 0, 0
        for level, plane in enumerate(self.planes):
            ones = plane.rank1(ends)
            ends = plane.zeros + ones if token >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        low, high = self._range(token, start, self.n if stop is None else stop)
        return high - low

    def occurrences(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Places of the token, ascending, from its ``first``-th on."""
        low, high = self._range(token, 0, self.n)
        i = np.arange(low + first, high if most is None else min(high, low + first + most), dtype=np.int64)
        for level in range(len(self.planes)):
            plane = self.planes[len(self.planes) - 1 - level]
            one = bool(token >> level & 1)
            i = plane.select(i - plane.zeros if one else i, one)
        return i

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=3)
        known = np.array([d is not None for d in self.doc_ids], dtype=bool)
        parts = [np.array([d or 0 for d in self.doc_ids], dtype="<i8"), np.packbits(known), self.ends.astype("<i8")]
        parts = [squeeze.compress(p.tobytes()) for p in (*parts, *(plane.words for plane in self.planes))]
        head = {"ids": self.n, "docs": len(self.doc_ids), "width": len(self.planes), "parts": [len(p) for p in parts]}
        text = json.dumps(head).encode()
        return MAGIC + struct.pack("<I", len(text)) + text + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", data, 8)[0]
        head, at, parts = json.loads(data[12 : 12 + size]), 12 + size, []
        for length in head["parts"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + length]))
            at += length
        known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=head["docs"])
        doc_ids = [d if k else None for d, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known)]
        planes = [Plane(np.frombuffer(p, "<u8"), head["ids"]) for p in parts[3:]]
        return cls(planes, head["ids"], doc_ids, np.frombuffer(parts[2], "<i8"))


class WordEncoder:
    """Ids of whole texts, word by word, for a tokenizer that drops white space.

    Such a tokenizer never joins what white space parts, so the ids of a text are those of its
    words.  Words are remembered up to a bound, and so are the parts of plain ones; the library encodes
    what is new.  A plain word has printable ASCII and Latin-1 letters only: there, lower-casing
    is all that normalising does, and the tokenizer's own pattern says where the word is cut.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    #: The tokenizer's pattern over the lower-case letters of plain words.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.code = "H" if self.width <= 16 else "I"
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found = {}
        for word in new:
            if self.PLAIN.fullmatch(word) and "<|" not in word:
                ids = []
                for part in self.PARTS.findall(word.lower()):
                    known = self.parts.get(part)
                    if known is None:
                        known = self._encode(part)
                        if len(self.parts) < REMEMBERED:
                            self.parts[part] = known
                    ids.append(known)
                found[word] = b"".join(ids)
            else:
                found[word] = self._encode(word)
            if len(self.words) < REMEMBERED:
                self.words[word] = found[word]
        return found

    def encode_all(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each followed by the ids in ``end``, and where each one's end.

        Words are numbered first, so that one is looked up once in all the texts.
        """
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.words.get, words))
        new = self._learn([w for w, g in zip(words, got) if g is None])
        got = [new[w] if g is None else g for w, g in zip(words, got)]
        got.append(end)
        flat = np.frombuffer(b"".join(got), dtype=self.dtype)
        sizes = np.fromiter(map(len, got), np.int32, len(got)) // self.dtype.itemsize
        ends = np.cumsum(split.value_lengths().to_numpy())
        places = np.insert(numbered.indices.to_numpy(), ends, len(words))
        length = sizes[places]
        before = (np.cumsum(sizes) - sizes)[places]
        after = np.cumsum(length)
        ids = flat[np.arange(after[-1]) + np.repeat(before - (after - length), length)]
        return ids, after[ends + np.arange(len(ends))]

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.binary()).cast(pa.string()))[0]


@cache
def encoder_for(path: str) -> WordEncoder:
    """One encoder for a worker, so that its tasks share what it remembers."""
    return WordEncoder(path)


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, list]]:
    """Texts, null ones empty, and their doc_ids in runs of about RUN_BYTES, one text aside."""
    for batch in batches:
        texts, names = pc.fill_null(batch["text"], ""), batch["doc_id"].to_pylist()
        at = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)))
        low = 0
        while low < len(names):
            high = max(low + 1, int(np.searchsorted(at, at[low] + RUN_BYTES, side="right")) - 1)
            yield texts[low:high], names[low:high]
            low = high


def _shard_writer(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        encoder, done = encoder_for(tokenizer), []
        ids, doc_ids, ends, held = [], [], [], 0

        def close() -> None:
            # The order is fixed, so another attempt writes the same bytes to the same name.
            name = f"{root}/shard-{task:06d}-{len(done):06d}.ids"
            whole = np.concatenate(ids)
            shard = WaveletShard.of(whole, doc_ids[:], np.concatenate(ends), encoder.width)
            with store.open_output_stream(f"{name}.{attempt}.part", compression=None) as out:
                out.write(shard.to_bytes())
            store.move(f"{name}.{attempt}.part", name)
            done.append((task, len(done), name.rpartition("/")[2], len(doc_ids), len(whole)))
            ids.clear(), doc_ids.clear(), ends.clear()

        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for texts, names in _text_runs(batches):
            own, run_ends = encoder.encode_all(texts, end)
            low = first = 0
            while low < len(names):
                # The document that fills the shard is its last one.
                high = min(len(names), int(np.searchsorted(run_ends, first + shard_ids - held)) + 1)
                stop = int(run_ends[high - 1])
                ids.append(own[first:stop])
                ends.append(run_ends[low:high] + (held - first))
                doc_ids += names[low:high]
                held += stop - first
                if held >= shard_ids:
                    close()
                    held = 0
                low, first = high, stop
        if doc_ids:
            close()
        columns = list(zip(*done)) if done else [()] * 5
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["task", "number", "file", "docs", "ids"]
        )

    return write


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode whole texts of ``docs`` (doc_id, text) into shards in ``folder``, a store all executors reach.

    ``tokenizer`` is the path of a file for the tokenizers library, the same on every executor, whose
    tokenizer drops white space; no special tokens are added, and each document ends with ``end_id``.
    Documents are in ascending doc_id order, null first, repeated ids by their text's hash; a
    null text is empty.  Returns the shards in that order: task, number, file, docs, ids and
    start, the number of ids before the shard.  An empty table makes no shard.
    """
    small_batches(docs.sparkSession)
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_same"))
        .repartitionByRange("doc_id", "_same")
        .sortWithinPartitions("doc_id", "_same")
        .select("doc_id", "text")
    )
    schema = "task int, number int, file string, docs long, ids long"
    written = materialise(ordered.mapInArrow(_shard_writer(folder, tokenizer, end_id, shard_ids), schema))
    # One row for a task meets in one place, and then only the shards of a task.
    tasks = written.groupBy("task").agg(F.sum("ids").alias("_ids"))
    tasks = tasks.select("task", (F.sum("_ids").over(Window.orderBy("task")) - F.col("_ids")).alias("_before"))
    inside = F.sum("ids").over(Window.partitionBy("task").orderBy("number")) - F.col("ids")
    return written.join(tasks, "task").select(*written.columns, (F.col("_before") + inside).alias("start"))


def _shard_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    shard = WaveletShard.from_bytes(stream.read())
                ids = shard.ids().astype("<u4")
                begins = np.concatenate(([0], shard.ends[:-1]))
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), shard.ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(begins + start),
                        pa.array(shard.ends - begins),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_token_shards(shards: DataFrame, folder: str) -> DataFrame:
    """One row per document read from the files: doc_id, start, n_tokens, ids_crc32."""
    files = shards.select("file", "start").repartition(max(1, shards.count()))
    return files.mapInArrow(_shard_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _finder(folder: str, tokens: list[int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    shard = WaveletShard.from_bytes(stream.read())
                for token in tokens:
                    places = shard.occurrences(token)
                    docs = np.searchsorted(shard.ends, places, side="right")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(repeat(token, len(places))), pa.int32()),
                            pa.array(places + start),
                            pa.array([shard.doc_ids[d] for d in docs], pa.int64()),
                        ],
                        names=["token", "place", "doc_id"],
                    )

    return find


def find_tokens(shards: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """(token, place, doc_id) of every occurrence, by rank and select in each shard."""
    files = shards.select("file", "start").repartition(max(1, shards.count()))
    return files.mapInArrow(_finder(folder, tokens), "token int, place long, doc_id long")
