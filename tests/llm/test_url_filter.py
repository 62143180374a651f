"""URL verdicts against a walk over the links."""

from __future__ import annotations

import random

from faultline.llm.components import components
from faultline.llm.url_filter import url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SCHEMA = "page_id long, url string, html string"


def canonical(target):
    return f'<html><LINK href="{target}" data-x=1 rel="Canonical"></html>'


def refresh(target):
    return f'<meta http-equiv="refresh" content="0; url={target}">'


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.Example.NET/en/x?y#z", ""),
            (2, "https://example.net/de/", None),
            (3, "https://sub.example.com/de/x", ""),
            (4, "https://badexample.com/de/x", ""),
            (5, "x://org/fr/", ""),
            (6, "no scheme", ""),
            (7, None, canonical("http://x.net/")),
            (8, "http://net", ""),
            (9, "http://host?q=://net/", ""),
            (10, "http://İ.ÄB.net#f", ""),
        ],
        SCHEMA,
    )
    got = verdicts(url_filter(pages, RULES))
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3] == ("sub.example.com", "/de/x", "example.com/de/", "block")
    assert got[4] == ("badexample.com", "/de/x", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("net", "", None, "allow")  # the rule's path asks for a slash
    assert got[9] == ("host", "", None, "allow")
    assert got[10][:2] == ("İ.Äb.net", "")


def test_blocks_reach_aliases(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/1", refresh("/2")),
            (2, "http://a.com/2#top", canonical("//b.com/3?x=1&amp;y=2")),
            (3, "https://b.com/3?x=1&y=2", canonical("http://bad.net/")),  # a target that is no page
            (4, "http://b.com/3?x=1", ""),
            (5, "http://fine.org/fr/", canonical("http://a.com/1")),  # allowed by its own rule
            (6, "http://c.com/dir/x", canonical("y")),
            (7, "http://c.com/dir/y", ""),
        ],
        SCHEMA,
    )
    got = {k: v[3] for k, v in verdicts(url_filter(pages, RULES)).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    known = spark.createDataFrame([("http://c.com/dir/y", "http://z.net/"), (None, "http://a.net/")], "url string, target string")
    got = {k: v[3] for k, v in verdicts(url_filter(pages, RULES, known)).items()}
    assert got[6] == got[7] == "block" and got[4] == "allow"


def test_empty_repeated_and_clashing(spark):
    assert url_filter(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    pages = spark.createDataFrame(
        [(1, "http://a.net/", "", "v", "k", 1), (1, "http://a.net/", "", "v", "k", 1)],
        SCHEMA + ", verdict string, _key string, component long",
    )
    assert [r.verdict for r in url_filter(pages, RULES).collect()] == ["block", "block"]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(500)] + [(3, None), (9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in parent} and len(got) == len(parent)
