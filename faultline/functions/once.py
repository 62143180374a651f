"""Columns that are computed once, whatever the optimizer moves around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that later filters do not compute again.

    A filter on a plain computed column is pushed below its projection, and the
    expression goes with it.  A one-element generator stops that.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
