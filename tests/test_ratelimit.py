"""The parallel token bucket against an event-by-event one."""

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from faultline.operators.ratelimit import (
    compose,
    decide,
    decisions,
    limiter_stats,
    mark_sampled,
    rate_limit,
    run_steps,
    suggested_sample_rate,
    summarise,
    units,
)

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def bucket(times, rate, burst):
    """Verdicts of a plain token bucket; times in microseconds."""
    tokens, last, out = Fraction(burst), None, []
    for t in times:
        now = t if last is None else max(t, last)
        if last is not None:
            tokens = min(Fraction(burst), tokens + Fraction(rate * (now - last), 10**6))
        last = now
        out.append(tokens >= 1)
        if tokens >= 1:
            tokens -= 1
    return out


def arrival_times(rng, n, rate, burst):
    """Bursts, floods at about the rate, and lulls that may or may not refill."""
    gap = 10**6 // max(rate, 1)
    t, times = 10**15, []
    while len(times) < n:
        mode = rng.choice(["flood", "steady", "lull", "same", "edge"])
        for _ in range(rng.randint(1, 3 * burst + 3)):
            t += {
                "flood": rng.randint(0, gap // 3 + 1),
                "steady": rng.randint(gap // 2, gap + gap // 2 + 1),
                "lull": rng.randint(0, 3 * gap * burst + 1),
                "same": 0,
                "edge": rng.choice([gap, gap - 1, gap + 1, gap * burst]),
            }[mode]
            times.append(t)
    return times[:n]


@pytest.mark.parametrize("seed", range(60))
def test_blocks_equal_plain_bucket(seed):
    rng = random.Random(seed)
    rate, burst = rng.choice([(1, 1), (3, 2), (7, 5), (100, 3), (100, 500), (999, 4), (5, 0)])
    times = arrival_times(rng, 400, rate, burst)
    token, refill = units(rate)
    slack = token * (burst - 1)
    barriers = [token * (k + 1) - refill * t for k, t in enumerate(times)]
    state, got = None, []
    at = 0
    while at < len(times):
        size = rng.randint(1, 60)
        block = barriers[at : at + size]
        verdicts, after = decide(state, block, slack, token)
        got += verdicts
        state = run_steps(state, summarise(block, slack, token), token)
        assert state == after
        at += size
    assert got == bucket(times, rate, burst)


def test_summaries_stay_short():
    rng = random.Random(1)
    times = arrival_times(rng, 20000, 100, 50)
    token, refill = units(100)
    barriers = [token * (k + 1) - refill * t for k, t in enumerate(times)]
    assert len(summarise(barriers, token * 49, token)) <= 6


@pytest.mark.parametrize("seed", range(30))
def test_composed_summaries_act_as_their_parts(seed):
    rng = random.Random(seed)
    rate, burst = rng.choice([(1, 1), (3, 2), (7, 5), (100, 3), (999, 4), (5, 0)])
    times = arrival_times(rng, 300, rate, burst)
    token, refill = units(rate)
    slack = token * (burst - 1)
    barriers = [token * (k + 1) - refill * t for k, t in enumerate(times)]
    cuts = sorted(rng.sample(range(1, 300), 12))
    blocks = [barriers[a:b] for a, b in zip([0, *cuts], [*cuts, 300])]
    parts = [summarise(block, slack, token) for block in blocks]
    # Any bracketing of the blocks gives the same function of the entry state.
    at = rng.randint(1, 12)
    halves = [compose(parts[:at], token), compose(parts[at:], token)]
    whole = summarise(barriers, slack, token)
    for entry in (None, *(h + rng.randint(-3, 3) * token + rng.randint(0, token) for h in barriers[::25])):
        state = entry
        for steps in parts:
            state = run_steps(state, steps, token)
        for steps in (compose(parts, token), compose(halves, token), whole):
            assert run_steps(entry, steps, token) == state


def test_blocks_meet_in_groups_only(spark):
    """The summaries of the blocks are worked out once, and a key's blocks meet group by group."""
    df = spark.range(2000).selectExpr(
        "'hot' AS key", "id AS seq", "timestamp_micros(id * 5000) AS ts"
    )
    verdicts = decisions(df, rate=100, burst=5, block_rows=4, group_blocks=25)
    whole = decisions(df, rate=100, burst=5)
    assert sorted(map(tuple, verdicts.collect())) == sorted(map(tuple, whole.collect()))
    verdicts.collect()
    final = verdicts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FlatMapGroupsInArrow summary(") <= 1 or "ReusedExchange" in final
    assert final.count("group_summary(") == 1


@pytest.mark.parametrize("block_rows, group_blocks", [(1, 7), (16, 1), (16, 5), (1 << 16, 1024)])
def test_frames(spark, block_rows, group_blocks):
    rng = random.Random(block_rows)
    rows, want = [], {}
    for key, n in (("hot", 900), ("b", 60), (None, 40)):
        times = arrival_times(rng, n, 10, 5)
        if key == "b":
            rng.shuffle(times)  # time never runs backwards in the limiter
        for seq, (t, ok) in enumerate(zip(times, bucket(times, 10, 5))):
            rows.append((key, seq * 3, t))
            want[(key or "", seq * 3)] = ok
    df = spark.createDataFrame(rows, "source string, seq bigint, us bigint").withColumn(
        "ts", F.timestamp_micros("us")
    )
    limited = rate_limit(df, "source", rate=10, burst=5, block_rows=block_rows, group_blocks=group_blocks)
    got = {(r.limiter_key, r.seq): r.allowed for r in limited.collect()}
    assert got == want
    stats = {r.limiter_key: (r.allowed, r.dropped) for r in limiter_stats(limited).collect()}
    passed = sum(v for (k, _), v in want.items() if k == "hot")
    assert stats["hot"] == (passed, 900 - passed)
    marked = mark_sampled(limited, limiter_stats(limited)).where("limiter_key = 'hot'")
    assert {r.sampled for r in marked.collect()} == {f"1/{900 // passed}"}


def test_documented_cases(spark):
    def verdicts(offsets_ms, rate, burst):
        df = spark.createDataFrame(
            [("s", i, T0 + dt.timedelta(milliseconds=ms)) for i, ms in enumerate(offsets_ms)],
            "source string, seq bigint, ts timestamp",
        )
        return [r.allowed for r in rate_limit(df, rate=rate, burst=burst).orderBy("seq").collect()]

    assert verdicts([0] * 6, 10, 5) == [True] * 5 + [False]
    assert verdicts([0, 0, 15], 100, 1) == [True, False, True]
    assert verdicts([0] * 5, 1, 2) == [True, True, False, False, False]


def test_missing_times(spark):
    df = spark.createDataFrame(
        [("s", i, t) for i, t in enumerate([None, None, None, T0, None, T0])],
        "source string, seq bigint, ts timestamp",
    )
    got = [r.allowed for r in rate_limit(df, rate=1, burst=2).orderBy("seq").collect()]
    assert got == [True, True, False, True, True, False]


def test_sample_rate(spark):
    df = spark.createDataFrame([(1, 9), (0, 9), (0, 0), (3, 4)], "a bigint, d bigint")
    got = df.select(suggested_sample_rate(F.col("a"), F.col("d")).alias("n")).collect()
    assert [r.n for r in got] == [10, 1, 1, 2]


def test_repeated_seq_fails_loudly(spark):
    df = spark.createDataFrame([("k", 1), ("k", 1)], "source string, seq bigint").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    with pytest.raises(Exception, match="seq repeats"):
        rate_limit(df).collect()


def spread_bucket(batches, rate, burst):
    """How many of each batch pass a bucket capped when the batch's time began; times in microseconds."""
    tokens, last, out = Fraction(burst), None, []
    for since, now, n in batches:
        if last is not None:
            tokens = min(Fraction(burst), tokens + Fraction(rate * (since - last), 10**6))
        tokens += Fraction(rate * (now - since), 10**6)
        passed = min(n, int(tokens))
        tokens, last = min(Fraction(burst), tokens - passed), now
        out.append(passed)
    return out


def decided(batches, rate, burst, size):
    """Passed events of each batch through ``decide``, in blocks of ``size`` carried on by their steps."""
    token, refill = units(rate)
    events = [(since, now, b) for b, (since, now, n) in enumerate(batches) for _ in range(n)]
    barriers = [token * (k + 1) - refill * now for k, (_, now, _) in enumerate(events)]
    slacks = [token * (burst - 1) + refill * (now - since) for since, now, _ in events]
    state, out = None, [0] * len(batches)
    for at in range(0, len(events), size):
        part = slice(at, at + size)
        verdicts, after = decide(state, barriers[part], slacks[part], token)
        state = run_steps(state, summarise(barriers[part], slacks[part], token), token)
        assert state == after
        for (_, _, b), passed in zip(events[part], verdicts):
            out[b] += passed
    return out


@pytest.mark.parametrize("seed", range(30))
def test_batches_use_the_refill_of_their_time(seed):
    rng = random.Random(seed)
    rate, burst = rng.choice([(1, 1), (7, 5), (100, 500), (3, 40)])
    now, batches = 10**15, []
    for _ in range(12):
        since = now + rng.choice([0, 0, 0, 90_000_000])
        now = since + rng.choice([10**6, 60_000_000])
        batches.append((since, now, rng.randint(0, 3 * rate * 60)))
    assert decided(batches, rate, burst, rng.randint(1, 999)) == spread_bucket(batches, rate, burst)


def test_a_steady_stream_in_long_batches_loses_nothing():
    minute = 60_000_000
    steady = [(k * minute, (k + 1) * minute, 50 * 60) for k in range(10)]
    assert sum(decided(steady, 100, 500, 4096)) == 30_000
    flood = decided([(since, now, 200 * 60) for since, now, _ in steady], 100, 500, 4096)
    assert flood == [6500] + [6000] * 9


def test_origins_of_a_key_are_merged_by_time(spark):
    rows = [("k", "a", i, T0 + dt.timedelta(seconds=i)) for i in range(40)]
    rows += [("k", "b", i, T0 + dt.timedelta(seconds=i, milliseconds=500)) for i in range(40)] + [("k", None, 0, None)]
    events = spark.createDataFrame(rows, "source string, origin string, seq long, ts timestamp")
    got = rate_limit(events.repartition(5), rate=1, burst=3, block_rows=7)
    assert set(got.columns) == {"limiter_key", "seq", "source", "origin", "ts", "allowed"}
    order = sorted(rows, key=lambda r: (r[3] or dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), r[1] or "", r[2]))
    times = [int((r[3].timestamp() if r[3] else 0) * 10**6) for r in order]
    want = {(r[1], r[2]): v for r, v in zip(order, bucket(times, 1, 3))}
    assert {(r.origin, r.seq): r.allowed for r in got.collect()} == want
