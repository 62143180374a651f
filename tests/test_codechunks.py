"""Chunks, batches and frame lookups against plain loops."""

import hashlib
import random
import re

import pytest

from faultline.operators.codechunks import (
    chunk_accounting,
    chunk_batches,
    chunk_counts,
    extract_chunks,
    file_offsets,
    frame_chunks,
)

DEF = re.compile(r"^([ \t]*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(")


def plain_chunks(path, source):
    lines = source.split("\n")
    found = []
    for i, line in enumerate(lines):
        m = DEF.match(line)
        if not m:
            continue
        end = len(lines)
        for j in range(i + 1, len(lines)):
            body = lines[j].lstrip(" \t")
            if body and body[0] != "#" and len(lines[j]) - len(body) <= len(m[1]):
                end = j
                break
        rest = line[line.index("(") + 1 :]
        word = next((w for w in ("self", "cls") if rest.startswith(w)), None)
        method = word and (rest == word or rest[len(word)] in ",) \t:")
        content = "\n".join(lines[i:end])
        digest = hashlib.sha256(f"{path}\n{content}".encode()).hexdigest()
        found.append(
            (path, i + 1, end, "method" if method else "function", m[2], "python", content, digest)
        )
    return found


FIXED = {
    "two.py": "def a():\n    return 1\n\ndef b(x):\n    return x\n",
    "cls.py": "class A:\n    def f(self):\n        pass\n    @classmethod\n    def g(cls, x): pass\n"
    "    def h(selfish):\n        pass\n    def i(self\n    ):\n        pass\n    def j(self):pass",
    "async.py": "async  def go (cls):\n\treturn 1\n# c\n\n\tx = 2\n  \nend = 1",
    "nest.py": "def outer():\n  def inner():\n    pass\n  # note\n  return inner\n\n\n",
    "tail.py": "def f():\n  pass\n   \n# trailing",
    "none.py": "x = 1\n",
    "empty.py": "",
}


def random_source(rng):
    pool = ["def f%d(self):", "def g%d(x):", "async def h%d(cls):", "x = %d", "# c%d", "", "class K%d:"]
    lines = []
    for i in range(rng.randint(1, 60)):
        word = rng.choice(pool)
        lines.append(" " * rng.choice([0, 0, 2, 4, 8]) + (word % i if "%d" in word else word))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def files():
    rng = random.Random(2)
    return FIXED | {f"d{i % 4}/r{i}.py": random_source(rng) for i in range(40)}


def test_chunks(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    rows = extract_chunks(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file_path, r.chunk_no)):
        got.setdefault(r.file_path, []).append(tuple(r)[1:])
    want = {p: plain_chunks(p, s) for p, s in files.items()}
    assert got == {p: c for p, c in want.items() if c}
    kinds = [c[3] for c in got["cls.py"]]
    assert kinds == ["method", "method", "function", "method", "method"]


def test_batches(spark, files):
    rows = [("big", p, s) for p, s in files.items()]
    rows += [("small", "a/b.py", "def a(): pass"), ("small", "a.py", "def b(): pass")]
    rows += [("small", "a-b.py", "def c(): pass")]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    repos = spark.createDataFrame(
        [(r, f"u/{r}", "main", "sha") for r in ("big", "small", "bare")],
        "repo string, repo_url string, branch string, source_sha string",
    )
    out = chunk_batches(df, repos, batch_chunks=7).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.repo_name, r.batch_no)):
        got.setdefault(r.repo_name, []).append(r)
    order = sorted(files, key=lambda p: p.split("/"))
    want = [c for p in order for c in plain_chunks(p, files[p])]
    full = [b for b in got["big"] if not b.done]
    assert [b.batch_no for b in full] == list(range(-(-len(want) // 7)))
    assert [tuple(c) for b in full for c in b.chunks] == want
    assert all(len(b.chunks) == 7 for b in full[:-1])
    assert [(b.done, len(b.chunks)) for b in got["big"][len(full) :]] == [(True, 0)]
    assert got["big"][-1].batch_no == len(full)
    assert [c.file_path for c in got["small"][0].chunks] == ["a/b.py", "a-b.py", "a.py"]
    assert [(b.done, b.batch_no) for b in got["bare"]] == [(True, 0)]
    assert got["bare"][0].repo_url == "u/bare"


def test_accounting(spark):
    rows = [
        ("fine", 0, 50, True), ("fine", 1, 3, True),
        ("late", 0, 50, True), ("late", 1, 50, False), ("late", 2, 9, True),
        ("dead", 0, 4, False),
    ]
    df = spark.createDataFrame(rows, "repo string, batch_no bigint, chunks bigint, ok boolean")
    got = {r.repo: (r.shipped, r.dropped) for r in chunk_accounting(df).collect()}
    assert got == {"fine": (53, 0), "late": (50, 59), "dead": (0, 4)}


def test_counts_are_those_of_the_chunks(spark, files):
    df = spark.createDataFrame(
        [("r", p, s) for p, s in files.items()] + [("r", "none.py", None)],
        "repo string, path string, content string",
    )
    got = {r.file_path: r.file_chunks for r in chunk_counts(df).collect()}
    cut = {p: len(plain_chunks(p, s)) for p, s in files.items()}
    assert got == {p: n for p, n in cut.items() if n}


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_offsets_follow_the_walk(spark, parts):
    paths = ["a.py", "a/b.py", "a/b/c.py", "a/b/d/e.py", "a/c.py", "a-b.py", "b/a/x.py", "b/a/y/z.py", "z.py"]
    counts = [("r", p, i + 1) for i, p in enumerate(paths)] + [("s", "q/w.py", 5)]
    df = spark.createDataFrame(counts, "repo string, file_path string, file_chunks bigint")
    got = {(r.repo, r.file_path): r.chunks_before for r in file_offsets(df, parts).collect()}
    want, total = {("s", "q/w.py"): 0}, 0
    for path in sorted(paths, key=lambda p: p.split("/")):
        want["r", path] = total
        total += paths.index(path) + 1
    assert got == want


@pytest.mark.parametrize("bin_lines, hot_parts", [(1, 3), (5, 50), (64, 400)])
def test_frame_lookup(spark, files, bin_lines, hot_parts):
    rng = random.Random(4)
    frames = []
    for i in range(400):
        path = rng.choice([*files, "missing.py"])
        frames.append((i, path, rng.choice([None, 1, 1, 1, rng.randint(0, 70)])))
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    chunks = extract_chunks(df)
    asked = spark.createDataFrame(frames, "id bigint, filename string, lineno bigint")
    got = {
        r.id: (r.chunk_name, r.chunk_start_line)
        for r in frame_chunks(asked, chunks, bin_lines=bin_lines, hot_parts=hot_parts).collect()
    }
    plain = {p: plain_chunks(p, s) for p, s in files.items()}
    want = {}
    for i, path, line in frames:
        inside = [c for c in plain.get(path, []) if line is not None and c[1] <= line <= c[2]]
        best = max(inside, key=lambda c: c[1], default=None)
        want[i] = (best[4], best[1]) if best else (None, None)
    assert got == want
