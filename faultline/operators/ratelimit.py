"""Token-bucket rate limiting, exact, and parallel within one key.

Count tokens in whole units: one token is ``token`` units and a microsecond
refills ``refill`` units, so ``rate`` tokens a second need no fractions.  Write
the tokens left after event ``k`` (at time ``t``) as ``z + refill*t - token*k``.
Between events ``z`` then stays put, and event ``k`` with
``h = token*(k+1) - refill*t`` does just this:

* the bucket holds at most ``burst`` tokens: ``z`` drops to ``h + slack`` at most,
  with ``slack = token*(burst-1)``;
* the event passes when ``z >= h``; else it is dropped and, as no token was
  taken, ``z`` rises by ``token``.

So a run of events is a sequence of caps and lifts, and neither the barrier ``h``
nor the cap depends on earlier decisions.  Successive caps merge into the lowest,
successive lifts into the highest, so a whole block of events shrinks to a
handful of numbers whatever state it will be entered with.  A key is therefore
cut into blocks that are summarised in parallel, and the blocks decide in parallel from
their known entry state.  Summaries compose: those of consecutive blocks shrink to one for
their group, only the groups of a key are run through in order, and then each group's blocks.

Events that were only seen together, as a micro-batch, have come one by one since the batch
before.  They share the time ``t`` of their batch; the bucket was capped when that time began, at
``since``, and what it refilled from then on is theirs.  Only the cap changes:
``h + slack + refill*(t - since)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.scan import bucket_of, with_totals_before
from faultline.session import materialise

DEFAULT_RATE = 100
DEFAULT_BURST = 500
BLOCK_ROWS = 1 << 18
# Blocks whose summaries meet in one task.
GROUP_BLOCKS = 1 << 10
CAP, LIFT, SET = 0, 1, 2

Step = tuple[int, int]


def units(rate: int) -> tuple[int, int]:
    """(units per token, units refilled per microsecond)."""
    shared = math.gcd(rate, 1_000_000) or 1
    return 1_000_000 // shared, rate // shared


def lift(z: int, barrier: int, token: int) -> int:
    """``z`` raised by whole tokens until it reaches ``barrier``."""
    return z if z >= barrier else z + -((z - barrier) // token) * token


def _with_caps(barriers: Sequence[int], slack: int | Sequence[int]) -> Iterable[tuple[int, int]]:
    slacks = [slack] * len(barriers) if isinstance(slack, int) else slack
    return ((h, h + s) for h, s in zip(barriers, slacks))


class Summary:
    """The steps that a run of caps and lifts applies to any entry state."""

    def __init__(self, token: int):
        self.token = token
        self.steps: list[Step] = []
        self.low = self.high = None  # bounds on every state the run can be in

    def cap(self, value: int) -> None:
        if self.high is not None and value >= self.high:
            return
        if self.low is not None and value <= self.low:
            self.steps, self.low = [(SET, value)], value
        elif self.steps and self.steps[-1][0] == CAP:
            self.steps[-1] = (CAP, value)
        else:
            self.steps.append((CAP, value))
        self.high = value

    def lift(self, value: int) -> None:
        if self.low is not None and value <= self.low:
            return
        if self.low is not None and self.low == self.high:
            self.set(lift(self.low, value, self.token))
            return
        if self.steps[-1][0] == LIFT:
            self.steps[-1] = (LIFT, value)
        else:
            self.steps.append((LIFT, value))
        self.low, self.high = value, max(self.high, value + self.token - 1)

    def set(self, value: int) -> None:
        self.steps, self.low, self.high = [(SET, value)], value, value


def summarise(barriers: Sequence[int], slack: int | Sequence[int], token: int) -> list[Step]:
    """The steps a block of events applies to any entry state; ``slack`` is one for all or one each."""
    summary = Summary(token)
    for h, cap in _with_caps(barriers, slack):
        if summary.high is None or cap < summary.high:
            summary.cap(cap)
        if summary.low is None or h > summary.low:
            summary.lift(h)
    return summary.steps


def compose(parts: Iterable[Iterable[Step]], token: int) -> list[Step]:
    """One list of steps that does what the given ones do in their order."""
    summary = Summary(token)
    act = {CAP: summary.cap, LIFT: summary.lift, SET: summary.set}
    for steps in parts:
        for kind, value in steps:
            act[kind](value)
    return summary.steps


def run_steps(z: int | None, steps: Iterable[Step], token: int) -> int | None:
    """State after the steps; ``None`` enters as a full, never used bucket."""
    for kind, value in steps:
        if kind == SET or (z is None and kind == CAP):
            z = value
        elif kind == CAP:
            z = min(z, value)
        elif z is not None:
            z = lift(z, value, token)
    return z


def decide(
    z: int | None, barriers: Sequence[int], slack: int | Sequence[int], token: int
) -> tuple[list[bool], int | None]:
    """Verdict for each event of a block entered in state ``z``, and the state after."""
    verdicts = []
    for h, cap in _with_caps(barriers, slack):
        if z is None or z > cap:
            z = cap
        passed = z >= h
        if not passed:
            z += token
        verdicts.append(passed)
    return verdicts, z


def _barriers(block: pa.Table, token: int, refill: int) -> list[int]:
    ranks = block.column("_rank").to_pylist()
    clocks = block.column("_clock").to_pylist()
    return [token * (k + 1) - refill * t for k, t in zip(ranks, clocks)]


def _slacks(block: pa.Table, slack: int, refill: int) -> int | list[int]:
    if "_waited" not in block.column_names:
        return slack
    return [slack + refill * w for w in block.column("_waited").to_pylist()]


def decisions(
    arrivals: DataFrame,
    rate: int = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    block_rows: int = BLOCK_ROWS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """``key, seq, allowed`` for arrivals given as ``key, seq, ts``.

    Arrivals are taken in ``seq`` order; time never runs backwards, a late or missing
    ``ts`` counts as the latest time seen.  ``seq`` is unique within a key.  With ``since``,
    arrivals of one ``ts`` have come between the two; NULL means at ``ts``.
    """
    token, refill = units(rate)
    slack = token * (burst - 1)
    batched = "since" in arrivals.columns
    waited = F.greatest(F.col("_clock") - F.coalesce("_since", "_clock"), F.lit(0)).alias("_waited")
    numbered = (
        with_totals_before(
            arrivals.select(
                F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
                F.col("seq").cast("bigint").alias("seq"),
                F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("_at"),
                *([F.unix_micros("since").alias("_since")] if batched else []),
            ),
            ["key"],
            "seq",
            sums={"_rank": F.lit(1)},
            maxima={"_seen": F.col("_at")},
            bucket_rows=block_rows,
            keep_bucket=True,
        )
        .withColumn("_clock", F.greatest("_at", "_seen"))
        .select("key", "_bucket", "seq", "_rank", "_clock", *([waited] if batched else []))
    )

    def written(key: tuple, place: str, steps: list[Step]) -> pa.Table:
        return pa.table(
            {
                "key": [key[0].as_py()],
                place: [key[1].as_py()],
                "kinds": pa.array([[k for k, _ in steps]], pa.list_(pa.int32())),
                "values": pa.array([[str(v) for _, v in steps]], pa.list_(pa.string())),
            }
        )

    def steps_of(summaries: pa.Table) -> list[list[Step]]:
        kinds, values = (summaries.column(c).to_pylist() for c in ("kinds", "values"))
        return [list(zip(k, map(int, v))) for k, v in zip(kinds, values)]

    def summary(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("seq")
        steps = summarise(_barriers(block, token, refill), _slacks(block, slack, refill), token)
        return written(key, "_bucket", steps)

    def group_summary(key: tuple, blocks: pa.Table) -> pa.Table:
        return written(key, "_group", compose(steps_of(blocks.sort_by("_bucket")), token))

    def entry_states(summaries: pa.Table, place: str, state: int | None) -> pa.Table:
        states = []
        for steps in steps_of(summaries):
            states.append(None if state is None else str(state))
            state = run_steps(state, steps, token)
        return pa.table(
            {
                "key": summaries.column("key"),
                place: summaries.column(place),
                "_entry": pa.array(states, pa.string()),
            }
        )

    def group_entries(groups: pa.Table) -> pa.Table:
        return entry_states(groups.sort_by("_group"), "_group", None)

    def entries(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("_bucket")
        entry = blocks.column("_entry")[0].as_py()
        return entry_states(blocks, "_bucket", None if entry is None else int(entry))

    def verdicts(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("seq")
        entry = block.column("_entry")[0].as_py()
        passed, _ = decide(
            None if entry is None else int(entry),
            _barriers(block, token, refill),
            _slacks(block, slack, refill),
            token,
        )
        order = block.column("seq")
        if pc.count_distinct(order).as_py() < len(order):
            raise ValueError(f"seq repeats in limiter key {key[0].as_py()!r}; verdicts would multiply rows")
        names = pa.array([key[0].as_py()] * len(passed), pa.string())
        return pa.table({"key": names, "seq": block.column("seq"), "allowed": passed})

    by = ["key", "_bucket"]
    summaries = (
        numbered.groupBy(*by)
        .applyInArrow(summary, "key string, _bucket bigint, kinds array<int>, values array<string>")
        .withColumn("_group", bucket_of(F.col("_bucket"), group_blocks))
    )
    # Both uses of the summaries are shuffled alike, so they are worked out once.
    groups = (
        summaries.groupBy("key", "_group")
        .applyInArrow(group_summary, "key string, _group bigint, kinds array<int>, values array<string>")
        .groupBy("key")
        .applyInArrow(group_entries, "key string, _group bigint, _entry string")
    )
    entered = (
        summaries.join(groups, ["key", "_group"])
        .groupBy("key", "_group")
        .applyInArrow(entries, "key string, _bucket bigint, _entry string")
    )
    return (
        numbered.join(entered, by)
        .groupBy(*by)
        .applyInArrow(verdicts, "key string, seq bigint, allowed boolean")
    )


def _in_arrival_order(arrivals: DataFrame) -> DataFrame:
    """Arrivals of several origins with ``_order``, an integer that sorts them by time, origin and seq.

    ``seq`` counts inside an origin only.  An origin's own clock never runs backwards; the
    origins of a key are merged by their clocks.  Sorted ranges are numbered row by row, and written
    down, as their borders are sampled.
    """
    timed = with_totals_before(
        arrivals.withColumn("_at", F.coalesce(F.unix_micros("ts"), F.lit(0))),
        ["key", "origin"],
        "seq",
        maxima={"_seen": F.col("_at")},
    ).withColumn("ts", F.timestamp_micros(F.greatest("_at", "_seen")))
    order = ["ts", "origin", "seq", "key"]
    ranged = timed.drop("_at", "_seen").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("_order", F.monotonically_increasing_id()))


def rate_limit(
    events: DataFrame,
    key: Column | str = "source",
    rate: int = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    block_rows: int = BLOCK_ROWS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """``events`` with ``limiter_key`` and ``allowed``.

    Needs ``ts`` and ``seq``, unique within a key (a repeated one fails the job); with a column
    ``origin`` it is unique within an origin of the key, and origins are merged by time.  ``since``
    is explained at ``decisions``.  Only key, order and times go through the limiter; the rows
    meet their verdicts in a join, which no hot key can skew.
    One bucket for everything is ``key=F.lit("")``.
    """
    column = F.col(key) if isinstance(key, str) else key
    keyed = events.withColumn("limiter_key", F.coalesce(column.cast("string"), F.lit("")))
    times = [c for c in ("ts", "since") if c in events.columns]
    arrivals = keyed.select(F.col("limiter_key").alias("key"), "seq", *times)
    if "origin" not in events.columns:
        verdicts = decisions(arrivals, rate, burst, block_rows, group_blocks).withColumnRenamed("key", "limiter_key")
        return keyed.join(verdicts, ["limiter_key", "seq"])
    named = F.coalesce("origin", F.lit("")).alias("origin")
    ordered = _in_arrival_order(keyed.select(F.col("limiter_key").alias("key"), named, "seq", *times))
    passed = decisions(
        ordered.select("key", F.col("_order").alias("seq"), *times), rate, burst, block_rows, group_blocks
    ).select(F.col("seq").alias("_order"), "allowed")
    verdicts = ordered.join(passed, "_order").select(
        F.col("key").alias("limiter_key"), F.col("origin").alias("_origin"), "seq", "allowed"
    )
    keyed = keyed.withColumn("_origin", F.coalesce("origin", F.lit("")))
    return keyed.join(verdicts, ["limiter_key", "_origin", "seq"]).drop("_origin")


def limiter_stats(limited: DataFrame, key: str = "limiter_key") -> DataFrame:
    """Allowed and dropped events per key, and the 1-in-N rate they suggest."""
    counts = limited.groupBy(key).agg(
        F.count_if("allowed").alias("allowed"),
        F.count_if(~F.col("allowed")).alias("dropped"),
    )
    return counts.withColumn(
        "sample_rate", suggested_sample_rate(F.col("allowed"), F.col("dropped"))
    )


def suggested_sample_rate(allowed: Column, dropped: Column) -> Column:
    """Whole part of (allowed + dropped) / allowed, 1 when nothing passed."""
    total = allowed + dropped
    return F.when(
        (total == 0) | (allowed == 0), F.lit(1).cast("bigint")
    ).otherwise(F.call_function("div", total, allowed))


def mark_sampled(limited: DataFrame, stats: DataFrame, key: str = "limiter_key") -> DataFrame:
    """Allowed rows with a ``sampled`` mark ``1/N`` where their key lost events.

    ``stats`` has one row per limiter key.
    """
    marks = stats.select(
        key, F.concat(F.lit("1/"), F.col("sample_rate").cast("string")).alias("_mark"), "dropped"
    )
    return (
        limited.where("allowed")
        .join(marks, key, "left")
        .withColumn("sampled", F.when(F.col("dropped") > 0, F.col("_mark")))
        .drop("_mark", "dropped")
    )
