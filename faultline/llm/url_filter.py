"""URL rules that reach a page's aliases.

A rule names a host with all its subdomains and the start of a path; the longest fitting rule
judges a url.  Redirects and canonical links join urls into groups of aliases, found as
connected components, and a block of one alias blocks the others.  An allow rule of a url's own
stands above what its aliases bring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ascii_lower
from faultline.llm.components import components
from faultline.session import materialise

#: Contents of ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` tags; attributes in any order.
LINK_TAG = r"(?is)<link\s(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
META_TAG = r"(?is)<meta\s(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null and others: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    ``rules`` are (verdict, host, path).  Rules that fit one url differ in host or path
    length unless they are the same; of equal lengths in sum, the longer host wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in reversed(ordered):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        said = F.struct(F.lit(f"{name}{start}").alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, said).otherwise(chosen)
    return chosen


def url_key(url: Column) -> Column:
    """What two spellings of one url share: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), F.lit(""))
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query)


def resolve(href: Column, url: Column) -> Column:
    """A link as an absolute url, seen from the page at ``url``."""
    origin = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^(.*?:)//", 1)
    folder = F.regexp_extract(url, r"^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(folder.endswith("/"), F.concat(folder, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and page-made redirects written in ``html``."""

    def target(tag: str, attribute: str, needs: str) -> Column:
        # The plain search is cheap; the pattern runs on pages that may have such a tag.
        found = F.regexp_extract(F.regexp_extract("html", tag, 0), attribute, 1)
        return F.when(F.lower(F.col("html")).contains(needs), found)

    href = F.explode(F.array(target(LINK_TAG, HREF, "canonical"), target(META_TAG, REFRESH_URL, "refresh")))
    return (
        pages.filter(F.col("url").contains("://"))
        .select("url", href.alias("_href"))
        .filter("_href is not null and _href <> ''")
        .select("url", resolve(F.replace("_href", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("target"))
        .filter(F.col("target").contains("://"))
    )


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of_blocked.

    ``pages`` has page_id, url and html; ``redirects`` (url, target) adds edges known from
    elsewhere, say from HTTP answers.  The verdict is that of the page's own rule; without one it
    is "block" if the page's url is joined, over any number of redirects and canonical
    links, to a url that a rule blocks, known as a page or only as a target; else ``default``.

    A null url or one without ``://`` has empty host and path, no aliases and no rule.  Null html
    has no links.  Every input row gives one row, repeated ones too; other columns are
    ignored; an empty table gives an empty one.  ``rules`` is configuration, held in the plan.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target").filter("url like '%://%' and target like '%://%'"))
    edges = materialise(
        edges.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b")).distinct()
    )
    groups = components(edges, "a", "b")
    # The host ends at the first slash of a key, the path at its question mark.
    key_host = F.substring_index("node", "/", 1)
    key_path = F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    judged = groups.withColumn("_said", rule_for(key_host, key_path, rules)["verdict"])
    blocked = judged.filter("_said = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("_key"))

    url = F.col("url")
    seen = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.when(url.contains("://"), url_key(url)).alias("_key"),
    ).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    met = seen.join(aliases.withColumn("_blocked", F.lit(True)), "_key", "left")
    reached = F.coalesce("_blocked", F.lit(False))
    return met.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(reached, "block").otherwise(default)).alias("verdict"),
        reached.alias("alias_of_blocked"),
    )
