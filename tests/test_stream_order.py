"""Rows of a micro-batch are put in order in bounded memory."""

import random
import tracemalloc

from pyspark.sql import Row

from faultline.streaming.order import by_seq

MADE = Row("key", "seq", "line")


def test_order_over_runs_is_that_of_a_sort():
    draw = random.Random(1)
    for n in (0, 1, 7, 8, 9, 64, 65, 700):
        rows = [MADE("k", draw.randrange(n // 2 + 1), f"line {i}") for i in range(n)]
        got = list(by_seq(iter(rows), run_rows=8, fan_in=4))
        assert got == sorted(rows, key=lambda r: r.seq)
        assert all(list(r.__fields__) == ["key", "seq", "line"] for r in got)


def test_memory_is_that_of_a_run():
    def peak(n):
        rows = (MADE("k", n - i, "x" * 200 + str(i)) for i in range(n))
        tracemalloc.start()
        assert sum(1 for _ in by_seq(rows, run_rows=1000, fan_in=8)) == n
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(24_000) < 2 * peak(6_000)
