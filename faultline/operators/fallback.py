"""Keyword fallback: the last layer, for records no other layer knows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import cut_bytes, let, trim_space
from faultline.schema import EVENT

# Words that mark a record as an error.
KEYWORDS = ("ERROR", "FATAL", "PANIC", "EXCEPTION", "TRACEBACK")


def has_keyword(text: Column, keywords: Sequence[str] = ()) -> Column:
    """The upper-cased text contains a keyword; custom ones replace the default."""
    words = keywords or KEYWORDS
    return let(
        F.upper(text),
        lambda upper: reduce(Column.__or__, [F.contains(upper, F.lit(w)) for w in words]),
    )


def fallback_event(
    text: Column,
    keywords: Sequence[str] = (),
    message_bytes: int | None = None,
    raw_line_bytes: int | None = None,
) -> Column:
    """EVENT of a record with a keyword, else NULL.

    The message and the ``raw_line`` tag hold the whole text unless a number of bytes is given.
    """
    missing = F.lit(None)

    def cut(value: Column, most: int | None) -> Column:
        return value if most is None else cut_bytes(value, most)

    return F.when(
        has_keyword(text, keywords),
        F.struct(
            F.lit("fallback"),
            F.lit("unknown"),
            F.lit("error"),
            cut(trim_space(text), message_bytes),
            missing,
            missing,
            missing,
            missing,
            missing,
            F.create_map(F.lit("raw_line"), cut(text, raw_line_bytes)),
        ).cast(EVENT),
    )
