"""Conversations brought back to the grammar ``(system? (user assistant)+)?`` at the least cost.

The roles of a conversation are aligned with the alternating string in the manner of Wagner and
Fischer: a cell (i, j) holds the cheapest way from turn i on, when j roles of the string stand.
Strings of all lengths that begin alike are prefixes of one another, so one table for each beginning
(with and without a system turn) aligns the turns to every feasible length: a length is one column at
which the last row may end.  A first repair, found in one pass, gives a cost to beat; cells that
cannot lie on a path of that cost are left out (Ukkonen's band), and what the first table finds narrows
the band of the second.  The audits of both are traced back and compared.

A table keeps every k-th row, k the square root of the turns, and makes the others again when the audit
passes them, so memory is a band times that root.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SPACE

RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
_FAR = 1 << 60


def _first_repair(initials: str, faults: np.ndarray) -> int:
    """Cost of one repair, in one pass: delete what has to go, give all others the role that is due."""
    cost, place, system = 0, 0, False
    for initial, fault in zip(initials, faults.tolist()):
        if fault in (BLANK, DUPLICATE):
            cost += DELETE
            continue
        cost += TRUNCATED if fault == CUT else 0
        if initial == "s" and place == 0:
            system = True
        elif initial != "ua"[(place - system) % 2]:
            cost += RETAG
        place += 1
    turns = place - system
    missing = 2 if system and not turns else turns % 2
    return cost + INSERT * missing


class _Table:
    """Cheapest ways from (turn i, place j) to an end of the strings that begin with a system turn or not.

    Row i covers the places from ``i - forced_i - behind`` on, where forced_i turns before i have to go.
    """

    def __init__(self, initials: str, faults: np.ndarray, system: bool, most: int):
        self.initials, self.faults, self.system, self.n = initials, faults, int(system), len(faults)
        self.goes = np.isin(faults, (BLANK, DUPLICATE))
        self.forced = np.concatenate(([0], np.cumsum(self.goes)))
        cut = int((faults == CUT).sum())
        spare = most - DELETE * int(self.forced[-1]) - TRUNCATED * cut
        # A truncated turn costs one more deleted than kept, a sound one four.
        self.behind = min(self.n, spare if spare <= cut else cut + (spare - cut) // DELETE)
        self.width = self.behind + spare // INSERT + 1
        self.step = max(64, isqrt(self.n))
        self.kept, self.block = {}, {}
        row = self._last()
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._before(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.cost = self.at(0, 0)

    def _base(self, i: int) -> int:
        return i - int(self.forced[i]) - self.behind

    def _insertions(self, i: int, row: np.ndarray) -> np.ndarray:
        """Any number of insertions before what ``row`` says; a system turn cannot be inserted."""
        first = max(0, self.system - self._base(i))
        slope = INSERT * np.arange(self.width - first) if first < self.width else np.empty(0, np.int64)
        row[first:] = np.minimum.accumulate((row[first:] + slope)[::-1])[::-1] - slope
        row[: max(0, -self._base(i))] = _FAR
        return row

    def _last(self) -> np.ndarray:
        place = self._base(self.n) + np.arange(self.width)
        ends = (place % 2 == self.system) & (place >= 3 * self.system)
        return self._insertions(self.n, np.where(ends, 0, _FAR))

    def _before(self, i: int, after: np.ndarray) -> np.ndarray:
        row = np.full(self.width, _FAR)
        if self.goes[i]:
            return self._insertions(i, after + DELETE)
        row[1:] = after[:-1] + DELETE
        kept = TRUNCATED if self.faults[i] == CUT else 0
        own, base = np.full(self.width, kept + RETAG), self._base(i)
        if self.initials[i] in "ua":
            own[("ua".index(self.initials[i]) + self.system - base) % 2 :: 2] = kept
        if self.system and 0 <= -base < self.width:
            own[-base] = kept if self.initials[i] == "s" else _FAR
        return self._insertions(i, np.minimum(row, after + own))

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            low = i - i % self.step
            high = min(low + self.step, self.n)
            self.block, row = {}, self.kept[high]
            for k in range(high - 1, low, -1):
                row = self._before(k, row)
                self.block[k] = row
        return self.block[i]

    def at(self, i: int, j: int) -> int:
        k = j - self._base(i)
        return int(min(self.row(i)[k], _FAR)) if 0 <= k < self.width else _FAR

    def audit(self) -> str:
        """The ASCII-least audit of the table's cost: at each cell the least letter that loses nothing."""
        out, i, j = [], 0, 0
        while i < self.n or self.at(i, j):
            left = self.at(i, j)
            role = "s" if self.system and not j else "ua"[(j - self.system) % 2]
            if i < self.n and self.at(i + 1, j) + DELETE == left:
                out.append("D")
                i += 1
            elif role != "s" and self.at(i, j + 1) + INSERT == left:
                out.append("I")
                j += 1
            else:
                out.append("K" if self.initials[i] == role else "R")
                i, j = i + 1, j + 1
        return "".join(out)


def repair_audit(initials: str, faults: np.ndarray) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least of equal ones; one initial a turn."""
    most, best = _first_repair(initials, faults), None
    for system in (False, True):
        table = _Table(initials, faults, system, most)
        if table.cost <= most:
            found = (table.cost, table.audit())
            best = found if best is None else min(best, found)
            most = best[0]
    return best


def _edits(audit: str) -> list[dict]:
    """What stands after the repair: place, pos of the turn (null: inserted) and role (null: its own)."""
    length = sum(letter != "D" for letter in audit)
    out, pos = [], 0
    for letter in audit:
        pos += letter != "I"
        if letter != "D":
            due = ("user", "assistant")[(len(out) - length % 2) % 2]
            at, role = None if letter == "I" else pos, None if letter == "K" else due
            out.append({"place": len(out) + 1, "pos": at, "role": role})
    return out


REPORT = (
    "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "_edits array<struct<place: long, pos: long, role: string>>"
)


def _report(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_pos")
    # Any other role has an initial too, though none that the grammar knows.
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r in rows["_initial"].to_pylist())
    faults = rows["_fault"].to_numpy()
    turns = rows["turn"].drop_null().to_numpy()
    cost, audit = repair_audit(initials, faults)
    pairs = [initials[k : k + 2] for k in range(len(initials) - 1)]
    counts = np.bincount(faults, minlength=4)
    return pa.table(
        {
            "conv_id": rows["conv_id"].slice(0, 1),
            "gaps": [int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0],
            "blank": [int(counts[BLANK])],
            "duplicate": [int(counts[DUPLICATE])],
            "truncated": [int(counts[CUT])],
            "illegal": [sum(p not in ("su", "ua", "au") for p in pairs)],
            "cost": [cost],
            "audit": [audit],
            "_edits": pa.array(
                [_edits(audit)],
                pa.list_(pa.struct([("place", pa.int64()), ("pos", pa.int64()), ("role", pa.string())])),
            ),
        }
    )


def _has_words(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(SPACE))) > 0


def judged_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with ``_pos`` (from 1 in its conversation) and ``_fault``, the first one found."""
    ordered = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("_pos")
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("_pos", F.row_number().over(ordered).cast("long"))
    fault = (
        F.when(~_has_words(F.col("text")), BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~F.right(F.btrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(SOUND)
    )
    return rows.withColumn("_fault", fault)


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of ``turns`` (conv_id, turn, role, text; other columns are left out).

    Turns stand in the order of ``turn``, nulls first, then of role and text.  A turn's first fault
    counts: *blank* (only white space), *duplicate* (role and text seen earlier in the conversation),
    *truncated* (its last character is none of ``.!?``).  Blank and duplicate turns have to go.
    To Keep costs 0, to Rerole as user or assistant 3, to Delete 4, to Insert an empty user or
    assistant turn 3; a truncated turn that stays costs 3 more.  The roles' initials have to read
    ``(s?(ua)+)?`` afterwards.

    report, a row for each conversation: conv_id, gaps (numbers missing between the least and
    the largest turn), blank, duplicate, truncated, illegal (neighbours whose initials are not
    su, ua or au), cost, audit (the edits' initials, of the cheapest the ASCII-least).
    repaired, a row for each turn that stands: conv_id, place (from 1), role, text.

    A null role or text is a single space, so a null text is blank.  Null conv_ids are one
    conversation, repeated rows are duplicates, texts are used whole, an empty table gives empty
    tables.  Faults are found by windows; a conversation's turns meet in one task as a few
    numbers each, without texts.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    judged = judged_turns(turns)
    report = (
        judged.select("conv_id", "turn", "_pos", "_fault", F.substring("role", 1, 1).alias("_initial"))
        .groupBy("conv_id")
        .applyInArrow(_report, REPORT.format(kind))
    )
    edits = report.select("conv_id", F.explode("_edits").alias("_e")).select(
        F.col("conv_id").alias("_conv"), "_e.place", F.col("_e.pos").alias("_at"), F.col("_e.role").alias("_role")
    )
    same = F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_at") == F.col("_pos"))
    repaired = edits.join(judged.select("conv_id", "_pos", "role", "text"), same, "left").select(
        F.col("_conv").alias("conv_id"),
        "place",
        F.coalesce("_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return report.drop("_edits"), repaired


def damage_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with known faults, by crc32 of ``conv_id:turn`` modulo 20; a null is a single space.

    0 drops a turn, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text, copies = shown("text"), F.when(F.col("_kind") == 3, 2).otherwise(1)
    return (
        turns.select("conv_id", "turn", shown("role").alias("role"), text.alias("text"), kind.alias("_kind"))
        .filter("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, "")
            .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
        )
        .drop("_copy")
    )
