"""Strict JSON access through VARIANT.

``try_parse_json`` accepts any text after the first value, and typed access turns
numbers into strings.  Both are ruled out here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import blank_to_null, let

# Fixed value: what JSON skips between values.
JSON_SPACE = " \t\n\r"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def sealed(text: Column, seal: Column) -> Column:
    """``text`` as the first element of a JSON list that ends with ``seal``.

    The seal comes second only if the text is one value and nothing else: text after
    it, another value, or a bracket that closes the list early all put something else
    there.  A hash of the text is a seal the text cannot hold.
    """
    return F.concat(F.lit("["), text, F.lit(","), seal, F.lit("]"))


def parse_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else NULL."""
    seal = F.xxhash64(text)

    def unseal(values: Column) -> Column:
        return F.when(
            F.try_variant_get(values, "$[1]", "bigint") == seal,
            F.try_variant_get(values, "$[0]", "variant"),
        )

    opens = F.ltrim(text, F.lit(JSON_SPACE)).startswith("{")
    return F.when(opens, let(F.try_parse_json(sealed(text, seal.cast("string"))), unseal))


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def string_field(value: Column, key: str) -> Column:
    """The field when it is a JSON string, else NULL."""
    return F.when(
        _kind(field(value, key)) == "STRING",
        F.try_variant_get(value, f"$.{key}", "string"),
    )


def first_string(value: Column, *keys: str) -> Column:
    """First of ``keys`` that holds a non-empty JSON string."""
    return F.coalesce(*(blank_to_null(string_field(value, key)) for key in keys))


def text_fields(value: Column, keys: Iterable[str]) -> Column:
    """Those of ``keys`` that hold a non-empty JSON string, as ``map<string,string>``.

    One pass over the object serves any number of look-ups by ``first_text``.
    """
    wanted = sorted(set(keys))
    members = F.try_variant_get(value, "$", "map<string,variant>")
    strings = F.map_filter(members, lambda k, v: k.isin(*wanted) & (_kind(v) == "STRING"))
    texts = F.transform_values(strings, lambda _, v: F.try_variant_get(v, "$", "string"))
    return F.map_filter(texts, lambda _, v: v != "")


def first_text(texts: Column, *keys: str) -> Column:
    """First of ``keys`` found in the map ``text_fields`` made."""
    return F.coalesce(*(F.try_element_at(texts, F.lit(key)) for key in keys))


def object_field(value: Column, path: str) -> Column:
    """The field when it is a JSON object, else NULL."""
    return F.when(
        F.try_variant_get(value, f"$.{path}", "struct<>").isNotNull(), field(value, path)
    )


def array_field(value: Column, path: str) -> Column:
    """Elements of a JSON array field as ``array<variant>``, else NULL."""
    return F.try_variant_get(value, f"$.{path}", "array<variant>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def number_field(value: Column, key: str) -> Column:
    """The field as DOUBLE when it is a JSON number, else NULL."""
    kind = _kind(field(value, key))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, f"$.{key}", "double"))
