"""Archives there and back, whole and damaged."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from faultline.llm.queries import op9_warc
from faultline.llm.warc import page_record, read_warc, salvage, write_warc

SCHEMA = "page_id long, url string, html string"


def records(n=40):
    rng = random.Random(1)
    pages = [("x%d " % i * rng.randrange(400)).encode() for i in range(n)]
    pages[7] = b"a page that shows an archive\r\n" + page_record(999, "u", b"inner", None, None, False)
    return [page_record(i, f"http://a/{i}", p, None, None, False) for i, p in enumerate(pages)]


def read(data):
    return list(salvage(pa.PythonFile(io.BytesIO(data), "r")))


def covered(rows, data):
    at = 0
    for _, begin, end, _ in rows:
        assert begin == at and end > begin
        at = end
    assert at == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    parts = [gzip.compress(r) if packed else r for r in records()]
    rows = read(b"".join(parts))
    assert [r[3]["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in range(40)]
    covered(rows, b"".join(parts))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [gzip.compress(r) if packed else r for r in records()]
    harm = list(parts)
    harm[3] = harm[3][: len(harm[3]) // 2]  # cut off
    harm[10] = harm[10][:60] + bytes([harm[10][60] ^ 0x55]) + harm[10][61:]  # a flipped byte
    harm[20] = harm[20] + b"junk between records"
    harm[30] = b"\0" * len(harm[30])
    harm[39] = harm[39][:-3]
    data = b"".join(harm)
    rows = read(data)
    covered(rows, data)
    ids = [r[3]["record_id"] for r in rows if r[0] == "record"]
    assert {f"<urn:page:{i}>" for i in range(40)} - set(ids) <= {f"<urn:page:{i}>" for i in (3, 10, 30, 39)}
    assert len(ids) >= 36 and [r for r in rows if r[0] == "gap"]
    gaps = sum(r[2] - r[1] for r in rows if r[0] == "gap")
    assert gaps <= sum(len(harm[i]) for i in (3, 10, 30, 39)) + 20


def test_odd_files():
    assert read(b"") == []
    assert [r[0] for r in read(b"nothing here" * 1000)] == ["gap"]
    big = page_record(1, "u", b"y" * 5_000_000, None, None, False)
    assert [r[0] for r in read(big + big)] == ["record"] * 2
    wrong = big.replace(b"yyyy\r\n\r\n", b"yyyz\r\n\r\n")
    assert [r[0] for r in read(wrong + big)] == ["gap", "record"]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("packed", [True, False])
def test_there_and_back(spark, tmp_path, packed):
    rows = [(i, f"http://h/{i}\r\n", f"page {i % 50} ü") for i in range(300)]
    rows += [(400, None, None), (401, "u", ""), (402, "u", "z" * 400_000), (None, "n", "page 1 ü"), (None, "n", "only null")]
    folder = f"file://{tmp_path}/out"
    files = write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, packed, file_bytes=20_000)
    assert files.count() > 3 and files.agg({"records": "sum"}).first()[0] == len(rows)
    got = read_warc(spark, folder).collect()
    assert len(got) == len(rows) and not any(r.gap for r in got)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", i)
    by_id = {r.record_id: r for r in got if r.record_id != "<urn:page:none>"}
    for i, _, html in rows:
        if i is None:
            continue
        r, response = by_id[f"<urn:page:{i}>"], first[html or ""]
        assert r.payload_digest == sha(html) and r.payload_bytes == len((html or "").encode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == response else ("revisit", f"<urn:page:{response}>"))
        assert r.payload is None if i != response else bytes(r.payload) == (html or "").encode()
    assert sorted(r.record_type for r in got if r.record_id == "<urn:page:none>") == ["response", "revisit"]


@pytest.mark.parametrize("packed", [True, False])
def test_long_urls(spark, tmp_path, packed):
    """Headers longer than the first look, and a revisit's with two urls."""
    urls = {1: "http://h/" + "a" * 100_000, 2: "http://h/" + "b" * 40_000, 3: "http://h/" + "c" * 40_000 + "/WARC/1.1", 4: "u"}
    rows = [(i, url, "same" if i in (2, 3) else f"page {i}") for i, url in urls.items()]
    folder = f"file://{tmp_path}/long"
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, packed)
    got = read_warc(spark, folder).collect()
    assert not any(r.gap for r in got)
    assert {r.record_id: r.url for r in got} == {f"<urn:page:{i}>": url for i, url in urls.items()}
    assert sorted(r.record_type for r in got) == ["response"] * 3 + ["revisit"]


def test_header_without_an_end():
    parts = [page_record(i, "u" * 100_000, b"page", None, None, False) for i in range(3)]
    head = parts[1].partition(b"\r\n\r\n")[0]
    rows = read(parts[0] + head + b"\r\n" + parts[2])
    assert [r[0] for r in rows] == ["record", "gap", "record"] and rows[2][3]["record_id"] == "<urn:page:2>"
    assert [r[0] for r in read(parts[0] + head)] == ["record", "gap"]


def test_empty_and_clashing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert write_warc(spark.createDataFrame([], SCHEMA), folder).collect() == []
    pages = spark.createDataFrame([(1, "u", "h", "x", 3)], SCHEMA + ", record_type string, _sha1 int")
    write_warc(pages, f"file://{tmp_path}/one")
    assert [r.record_type for r in read_warc(spark, f"file://{tmp_path}/one").collect()] == ["response"]


def test_query_keeps_negative_ids(spark, tmp_path):
    pages = [(-5, "http://a", "same"), (7, "http://b", "same"), (8, "http://c", None)]
    spark.createDataFrame(pages, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_warc(spark, str(tmp_path)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == [(-5, "response", None), (7, "revisit", -5), (8, "response", None)]
