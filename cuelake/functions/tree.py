"""Untyped JSON: documents as VARIANT, whose parts are looked at by their own types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree(text: Column) -> Column:
    """The JSON value that a text begins with, or null. What follows it is not read; an object that has a key twice is none."""
    return F.from_json(text, "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, or the type of a single value (VOID for null)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def field(value: Column, name: str) -> Column:
    """A field of an object; null where there is none, a VARIANT of null where it is there and null."""
    return F.when(kind(value) == "OBJECT", F.try_variant_get(value, f"$.{name}", "variant"))


def items(value: Column) -> Column:
    """The elements of an array, or null."""
    return F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def entries(value: Column) -> Column:
    """The fields of an object by name, or null."""
    return F.when(kind(value) == "OBJECT", F.try_variant_get(value, "$", "map<string,variant>"))


def text_of(value: Column) -> Column:
    """A single value as text: strings as they are, numbers in digits, True and False; empty for null, objects, arrays and what is
    not there."""
    of = kind(value)
    said = F.try_variant_get(value, "$", "string")
    return F.when(of.isin("OBJECT", "ARRAY", "VOID") | value.isNull() | said.isNull(), "").when(of == "BOOLEAN", F.initcap(said)).otherwise(said)


def is_false(value: Column) -> Column:
    """Whether it is the value false itself."""
    return F.coalesce((kind(value) == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"), F.lit(False))
