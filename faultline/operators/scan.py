"""Running totals over ordered keys, safe for a key that holds most rows.

A plain ``sum() OVER (PARTITION BY key ORDER BY seq)`` puts a whole key into one
task.  Here a key is cut into buckets of consecutive ``seq`` values:

1. bucket totals, combined map-side, one small row per (key, bucket);
2. a window over those rows gives each bucket the total of all earlier buckets;
3. a window inside each (key, bucket) adds the rows before the current one.

``seq`` is unique within a key, so a bucket never holds more than
``bucket_rows`` rows, whatever the data looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 18


def bucket_of(seq: Column, bucket_rows: int) -> Column:
    """Order-preserving bucket number of an integer ``seq``."""
    width = F.lit(bucket_rows).cast("bigint")
    return F.call_function("div", seq - F.pmod(seq, width), width)


def with_totals_before(
    df: DataFrame,
    keys: list[str],
    seq: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    descending: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add running sums and maxima over all strictly earlier rows of a key.

    A sum with no earlier row is 0, a maximum is NULL.  ``descending`` counts
    from the highest ``seq`` down.  ``keep_bucket`` leaves ``_bucket`` in place; with
    keys that cannot be NULL the result is partitioned by them and it.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = df.withColumn("_bucket", bucket_of(F.col(seq).cast("bigint"), bucket_rows))
    by = list(keys)
    if any(df.schema[key].nullable for key in keys):
        # As one struct, keys equal themselves even where a field is NULL.
        rows, by = rows.withColumn("_key", F.struct(*keys)), ["_key"]

    def ordered(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    partial = [F.sum(e).alias(f"_p_{n}") for n, e in sums.items()]
    partial += [F.max(e).alias(f"_p_{n}") for n, e in maxima.items()]
    buckets = rows.groupBy(*by, "_bucket").agg(*partial)
    across = (
        Window.partitionBy(*by)
        .orderBy(ordered("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = buckets.select(
        *by,
        "_bucket",
        *(F.sum(f"_p_{n}").over(across).alias(f"_c_{n}") for n in sums),
        *(F.max(f"_p_{n}").over(across).alias(f"_c_{n}") for n in maxima),
    )
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(ordered(seq))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = {f"_l_{n}": F.sum(e).over(inside) for n, e in sums.items()}
    local |= {f"_l_{n}": F.max(e).over(inside) for n, e in maxima.items()}
    joined = rows.withColumns(local).join(carried, [*by, "_bucket"])
    zero = F.lit(0)
    out = {
        n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)
        for n in sums
    }
    out |= {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in maxima}
    scratch = [f"_{p}_{n}" for n in (*sums, *maxima) for p in "lc"]
    if not keep_bucket:
        scratch.append("_bucket")
    return joined.withColumns(out).drop("_key", *scratch)
