"""Small column helpers for strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.patterns import SPACE_CHARS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A name bound by ``transform`` over a one-element array is a plain variable
    inside ``body``, however often it is mentioned there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def trim_blank_left(text: Column) -> Column:
    """Strip leading spaces and tabs only."""
    return F.ltrim(text, F.lit(" \t"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def cut_bytes(text: Column, size: int) -> Column:
    """First ``size`` UTF-8 bytes of ``text``.

    Every byte of a character cut in half becomes one U+FFFD.
    """
    raw = text.cast("binary")

    def continues(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    broken = (
        F.when(~continues(size + 1), 0)
        .when(~continues(size), 1)
        .when(~continues(size - 1), 2)
        .otherwise(3)
    )
    kept = F.substring(raw, F.lit(1), F.lit(size) - broken).cast("string")
    cut = F.concat(kept, F.repeat(F.lit("�"), broken))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def group(text: Column, pattern: str, index: int) -> Column:
    """Capture group ``index``; empty when the pattern or group is absent."""
    return F.regexp_extract(text, pattern, index)


def line_number(digits: Column) -> Column:
    """Parsed line number; NULL for 0, nothing, or out of range."""
    return F.nullif(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
