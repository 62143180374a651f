"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import shared_folder, table
from faultline.llm.conversation_repair import damage_turns, repair_conversations
from faultline.llm.dual_tree import top_k
from faultline.llm.exact_dedup import exact_dedup
from faultline.llm.lexical_search import lexical_search
from faultline.llm.line_dedup import line_dedup
from faultline.llm.lm_scoring import lm_scores
from faultline.llm.mixing import Mix
from faultline.llm.packing import best_fit_packing
from faultline.llm.simhash import simhash_groups
from faultline.llm.token_shards import read_token_shards, write_token_shards
from faultline.llm.toxicity import fit_machine, held_out, score_toxicity
from faultline.llm.url_filter import url_filter
from faultline.llm.warc import read_warc, write_warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), folder, tokenizer), folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"))
    machine = fit_machine(docs, table(spark, sf_dir, "labels").filter(~held))
    return score_toxicity(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken()


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


#: (verdict, host, path), as the contract of op7 gives them.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    told = ["record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "gap"]

    def page(field: str) -> Column:
        return F.regexp_extract(field, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return (
        read_warc(spark, folder, told)
        .filter("gap is null")
        .select(
            page("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            page("refers_to").alias("refers_to"),
        )
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair_conversations(damage_turns(turns))
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))))
    texts = repaired.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    all_of_them = turns.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def on_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnRenamed("conv_id", "_conv")
        return left.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    return on_conversation(on_conversation(all_of_them, report), texts).select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return lm_scores(table(spark, sf_dir, "documents"), held, ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_toxicity": op3_toxicity,
    "op4_dual_tree": op4_dual_tree,
    "op5_mix_sources": op5_mix_sources,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_lm_scoring": op13_lm_scoring,
}

#: crc32 of the text ``k`` bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(k)) + 1),
                 lambda i: ('0x' || substr(hex(encode(k)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                 lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ``[\x20\x09-\x0D]``
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _edit(state: str, cost: str, letter: str) -> str:
    """A state of op11's walk, nine digits of cost and an audit, after one more edit."""
    return f"(lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || {letter})"


def _turned(state: str, initial: str) -> str:
    """A turn that stays takes the role ``initial``: kept if it has it, else given it."""
    letter = f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END"
    cost = f"(CASE WHEN fault = 3 THEN 3 ELSE 0 END + CASE WHEN initial = '{initial}' THEN 0 ELSE 3 END)"
    return f"CASE WHEN fault NOT IN (1, 2) THEN {_edit(state, cost, letter)} END"


#: A-Z to a-z, as in ``ascii_lower``.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    "op4_dual_tree": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   list_sum(list_transform(list_zip(q.vector, v.vector), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op7_url_filter": f"""
        WITH RECURSIVE page AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
        ),
        href AS (
            SELECT url, unnest([
                regexp_extract(regexp_extract(html, '<link\\s[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'),
                               '\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'),
                regexp_extract(regexp_extract(html, '<meta\\s[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'),
                               '\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is')]) AS href
            FROM page WHERE contains(url, '://')
        ),
        link AS (
            SELECT url, CASE
                WHEN contains(href, '://') THEN href
                WHEN starts_with(href, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || href
                WHEN starts_with(href, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || href
                ELSE rtrim(regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || href END AS target
            FROM (SELECT url, replace(href, '&amp;', '&') AS href FROM href WHERE href <> '')
        ),
        u AS (SELECT url FROM page UNION SELECT target FROM link),
        part AS (
            SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}) AS host,
                   regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(url, '://[^?#]*(\\?[^#]*)', 1) AS query
            FROM u
        ),
        named AS (
            SELECT *, CASE WHEN contains(url, '://') THEN host || CASE path WHEN '' THEN '/' ELSE path END || query END AS key
            FROM part
        ),
        rules(verdict, rhost, rpath) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ),
        best AS (
            SELECT url, arg_max(verdict, length(rhost || rpath)) AS verdict,
                   arg_max(rhost || rpath, length(rhost || rpath)) AS rule
            FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY url
        ),
        edge AS (
            SELECT a.key AS a, b.key AS b FROM link JOIN named a USING (url) JOIN named b ON b.url = link.target
            WHERE a.key <> b.key
        ),
        both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
        reached(key) AS (
            SELECT key FROM named JOIN best USING (url) WHERE verdict = 'block' AND key IN (SELECT a FROM both_ways)
            UNION
            SELECT b FROM reached JOIN both_ways ON a = key
        )
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN r.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               r.key IS NOT NULL AS alias_of_blocked
        FROM page JOIN named USING (url) LEFT JOIN best USING (url) LEFT JOIN reached r USING (key)
    """,
    "op9_warc": """
        WITH page AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h
            FROM pages
        ),
        marked AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM page)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31)) + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM marked
    """,
    "op10_line_dedup": f"""
        WITH line AS (
            SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key
            FROM line
        ),
        held AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ),
        judged AS (
            SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM keyed k LEFT JOIN held USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    # Another way than the query's: the grammar's four states (before anything, after system, user,
    # assistant) are walked turn by turn, each with its cheapest audit so far.
    "op11_conversation_repair": f"""
        WITH RECURSIVE raw AS (
            SELECT *, {_CRC32} % 20 AS kind FROM (
                SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(conv_id::VARCHAR, ' ') AS cid, coalesce(conv_id::VARCHAR, ' ') || ':' ||
                       coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
        ),
        damaged AS (
            SELECT cid, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM raw WHERE kind <> 0
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS pos,
                   left(role, 1) AS initial, trim(text, {_WHITE}) AS words
            FROM damaged
        ),
        judged AS (
            SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY pos) || initial AS pair,
                   CASE WHEN words = '' THEN 1
                        WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 2
                        WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
            FROM placed
        ),
        walk(cid, pos, none, sys, usr, ast) AS (
            SELECT DISTINCT cid, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM judged
            UNION ALL
            SELECT cid, pos, none, sys,
                   least(usr, {_edit("none", "3", "'I'")}, {_edit("sys", "3", "'I'")}, {_edit("ast", "3", "'I'")}),
                   least(ast, {_edit("usr", "3", "'I'")}, {_edit("none", "6", "'II'")}, {_edit("sys", "6", "'II'")})
            FROM (
                SELECT cid, j.pos, {_edit("none", "4", "'D'")} AS none,
                       least({_edit("sys", "4", "'D'")},
                             CASE WHEN initial = 's' THEN {_turned("none", "s")} END) AS sys,
                       least({_edit("usr", "4", "'D'")}, {_turned("none", "u")}, {_turned("sys", "u")},
                             {_turned("ast", "u")}) AS usr,
                       least({_edit("ast", "4", "'D'")}, {_turned("usr", "a")}) AS ast
                FROM walk JOIN judged j USING (cid) WHERE j.pos = walk.pos + 1
            )
        ),
        best AS (
            SELECT cid, least(none, ast) AS found FROM walk
            QUALIFY row_number() OVER (PARTITION BY cid ORDER BY pos DESC) = 1
        ),
        letters AS (
            SELECT cid, generate_subscripts(l, 1) AS i, unnest(l) AS letter
            FROM (SELECT cid, string_split(substr(found, 10), '') AS l FROM best WHERE length(found) > 9)
        ),
        edits AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER upto AS pos, count(*) FILTER (letter <> 'D') OVER upto AS place,
                   count(*) FILTER (letter <> 'D') OVER (PARTITION BY cid) AS stand
            FROM letters WINDOW upto AS (PARTITION BY cid ORDER BY i)
        ),
        repaired AS (
            SELECT e.cid, string_agg(
                       CASE WHEN letter = 'K' THEN role WHEN (place - 1 - stand % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
                       || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS text
            FROM edits e LEFT JOIN judged j ON e.cid = j.cid AND e.pos = j.pos WHERE letter <> 'D' GROUP BY e.cid
        ),
        counts AS (
            SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY cid
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(left(found, 9)::BIGINT, 0) AS cost, coalesce(substr(found, 10), '') AS audit,
               sha256(coalesce(text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, cid FROM raw) LEFT JOIN counts USING (cid) LEFT JOIN best USING (cid)
             LEFT JOIN repaired USING (cid)
    """,
    "op12_lexical_search": f"""
        WITH doc AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS terms
            FROM documents
        ),
        size AS (
            SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc WHERE len(terms) > 0
        ),
        item AS MATERIALIZED (
            SELECT row_number() OVER () AS item, item_id,
                   regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS terms
            FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ),
        asked AS (
            SELECT item, term, count(*) AS repeats FROM (SELECT item, unnest(terms) AS term FROM item) GROUP BY ALL
        ),
        held AS (
            SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM doc)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ),
        weighed AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, size GROUP BY term, n_docs
        ),
        scored AS (
            SELECT item, row, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM held JOIN asked USING (term) JOIN weighed USING (term) JOIN (
                SELECT row, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM doc, size
            ) USING (row)
            GROUP BY ALL
        ),
        ranked AS (
            SELECT item, doc_id, score,
                   row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank
            FROM scored JOIN doc USING (row) WHERE score > 0
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN item USING (item) WHERE rank <= 20
    """,
}
