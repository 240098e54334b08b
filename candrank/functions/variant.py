"""Lenient readers over VARIANT columns, all JVM-side.

The readers follow a lax validator: a number may arrive as text or boolean, a boolean as
0/1 or a known word, while text must be text. Anything else reads as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import named, strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def with_json(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add ``name``: the VARIANT of a text that is one JSON value and nothing else.

    Spark's own parser stops after the first value and would take ``5 and more`` as 5.
    Here the text is the first of two array items and its hash the second, so text after
    the value breaks the array, adds items, or ends it before the hash.
    """
    mark = F.xxhash64("_text")
    listed = F.concat(F.lit("["), "_text", F.lit(","), mark.cast("string"), F.lit("]"))
    items = F.col("_items")
    alone = (F.try_variant_get(items, "$[1]", "bigint") == mark) & F.try_variant_get(
        items, "$[2]", "variant"
    ).isNull()
    return (
        df.withColumn("_text", text)
        .withColumn("_items", F.try_parse_json(listed))
        .withColumn(name, F.when(alone, F.try_variant_get(items, "$[0]", "variant")))
        .drop("_text", "_items")
    )


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read as values.

    A filter on a plain derived column is pushed below its projection together with a copy
    of the whole derivation, which parses the same text again for every mention of it. A
    generator keeps the derivation in one place: here one row in, one row out.
    """
    names = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*map(named, names), F.inline(F.array(row)))


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def items(value: Column, path: str) -> Column:
    """Array elements, or NULL where the path is absent or not an array."""
    return F.try_variant_get(value, path, "array<variant>")


def kind(value: Column) -> Column:
    """BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, STRING, ARRAY<..>, OBJECT<..> or VOID."""
    return F.schema_of_variant(value)


def absent(value: Column) -> Column:
    """The key is missing (an explicit JSON null is present)."""
    return value.isNull()


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT")), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def _numeric(which: Column) -> Column:
    return which.isin("BIGINT", "DOUBLE") | F.startswith(which, F.lit("DECIMAL"))


def text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    which = kind(value)
    plain = F.try_variant_get(value, "$", "double")
    word = strip(F.try_variant_get(value, "$", "string"))
    return F.when(_numeric(which) | (which == "BOOLEAN"), plain).when(
        (which == "STRING") & word.rlike(_NUMBER), word.try_cast("double")
    )


def boolean(value: Column) -> Column:
    which = kind(value)
    plain = F.try_variant_get(value, "$", "double")
    word = F.lower(F.try_variant_get(value, "$", "string"))
    return (
        F.when(which == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(which == "STRING", F.when(word.isin(*C.TRUE_WORDS), True).when(word.isin(*C.FALSE_WORDS), False))
        .when(_numeric(which), F.when(plain == 1.0, True).when(plain == 0.0, False))
    )


def truthy(value: Column) -> Column:
    """Non-empty, non-zero, not false; never NULL."""
    which = kind(value)
    return F.coalesce(
        F.when(which == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(which == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(_numeric(which), F.try_variant_get(value, "$", "double") != 0)
        .when(F.startswith(which, F.lit("OBJECT")), F.to_json(value) != "{}")
        .when(F.startswith(which, F.lit("ARRAY")), F.to_json(value) != "[]"),
        F.lit(False),
    )


def as_message(value: Column) -> Column:
    """Text as is, other JSON rendered."""
    return F.coalesce(text(value), F.to_json(value))
