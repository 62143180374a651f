"""Scrubbing of personal data and secrets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from faultline.functions.patterns import REDACTION_LITERALS, REDACTION_SHAPES, REDACTIONS
from faultline.functions.text import let

CUSTOM_MARKER = "[redacted]"


def usable_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The given expressions without those that do not compile."""
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    kept = []
    for pattern in patterns:
        try:
            compile_(pattern)
        except Exception:  # a Java PatternSyntaxException, through the gateway
            continue
        kept.append(pattern)
    return kept


def _scrub(name: str, pattern: str, marker: str) -> Callable[[Column], Column]:
    """One pattern, behind the cheapest test that rules most texts out."""
    literals, shape = REDACTION_LITERALS.get(name), REDACTION_SHAPES.get(name)

    def apply(text: Column) -> Column:
        replaced = F.regexp_replace(text, pattern, marker)
        if literals:
            tests = [F.contains(text, F.lit(part)) for part in literals]
            return F.when(reduce(Column.__or__, tests), replaced).otherwise(text)
        if shape:
            dotted = F.contains(text, F.lit("." if name == "ipv4" else ":"))
            return F.when(dotted & text.rlike(shape), replaced).otherwise(text)
        return replaced

    return apply


def redact(
    text: Column, enabled: Iterable[str] = (), custom: Iterable[str] = ()
) -> Column:
    """Replace what the patterns match, built-ins first, in their fixed order.

    No ``enabled`` names means all of them; unknown names match nothing.
    ``custom`` expressions must compile, see ``usable_patterns``.
    """
    wanted = set(enabled)
    for name, pattern, marker in REDACTIONS:
        if not wanted or name in wanted:
            text = let(text, _scrub(name, pattern, marker))
    for pattern in custom:
        text = F.regexp_replace(text, pattern, CUSTOM_MARKER)
    return text
