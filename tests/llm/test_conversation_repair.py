"""Repairs of conversations against a walk over the grammar's states, and against the query's SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from faultline.llm.conversation_repair import damage_turns, judged_turns, repair_audit, repair_conversations
from faultline.llm.queries import ORACLES, op11_conversation_repair
from tests.compare import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(initials, faults):
    """Every state's cheapest (cost, audit), turn by turn; a state is what the grammar has read last."""
    heirs = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for role in heirs[state].replace("s", ""):
                    found = (cost + 3, audit + "I")
                    states[role] = min(states.get(role, found), found)
        return states

    states = inserted({"": (0, "")})
    for initial, fault in zip(initials, faults):
        after = {}
        for state, (cost, audit) in states.items():
            ways = [(state, (cost + 4, audit + "D"))]
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                for role in heirs[state]:
                    if role == initial:
                        ways.append((role, (cost + extra, audit + "K")))
                    elif role != "s":
                        ways.append((role, (cost + extra + 3, audit + "R")))
            for role, found in ways:
                after[role] = min(after.get(role, found), found)
        states = inserted(after)
    return min(states[s] for s in ("", "a") if s in states)


def test_audits_match_the_walk():
    rng = random.Random(5)
    for n in [*range(9)] * 120 + [40, 90, 300, 700]:
        initials = "".join(rng.choice("suauauaua?") for _ in range(n))
        faults = np.array([rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)], dtype=np.int64)
        assert repair_audit(initials, faults) == brute(initials, faults.tolist()), (initials, faults)


def test_one_very_long_conversation():
    n = 6000
    initials = "s" + "ua" * (n // 2)
    faults = np.zeros(len(initials), dtype=np.int64)
    faults[7::100] = 1
    assert repair_audit(initials, faults) == brute(initials, faults.tolist())


def mixed(rng, conversations):
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "A longer answer, with a mark?  ", "word " * 4000, "u. "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice([role] * 9 + [None, "tool", ""])
            at = rng.choice([turn] * 9 + [None, turn + 3])
            rows.append((conv if conv else None, at, role, rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con


def test_query_against_sql_on_odd_rows(spark, tmp_path):
    rows = mixed(random.Random(11), 150)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    name = "op11_conversation_repair"
    assert compare(spark, duck(rows), name, op11_conversation_repair, ORACLES[name], str(tmp_path)) is None


def test_all_turns_dropped_stays(spark, tmp_path):
    rows = [(k, 0, "user", "Hi.") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    dropped = set(got) - {r.conv_id for r in damage_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert dropped
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    for k in dropped:
        assert (got[k].cost, got[k].audit, got[k].repaired_sha256) == (0, "", empty)


def test_real_outputs_empty_and_clashing(spark):
    columns = SCHEMA + ", _pos string, place int, audit string"
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "Be brief.", "x", 9, "z"),
            (1, 1, "user", "Why?", "x", 9, "z"),
            (1, 2, "user", "Why?", "x", 9, "z"),
            (1, 3, "assistant", "Because", "x", 9, "z"),
            (1, 4, "user", "Go on.", "x", 9, "z"),
        ],
        columns,
    )
    report, repaired = repair_conversations(turns)
    (row,) = report.collect()
    assert row.asDict() == dict(
        conv_id=1, gaps=0, blank=0, duplicate=1, truncated=1, illegal=1, cost=10, audit="KKDKKI"
    )
    got = sorted(map(tuple, repaired.collect()))
    assert got == [
        (1, 1, "system", "Be brief."),
        (1, 2, "user", "Why?"),
        (1, 3, "assistant", "Because"),
        (1, 4, "user", "Go on."),
        (1, 5, "assistant", ""),
    ]
    report, repaired = repair_conversations(turns.limit(0))
    assert report.collect() == [] and repaired.collect() == []
    assert damage_turns(turns.limit(0)).collect() == [] and judged_turns(turns.limit(0)).collect() == []
