"""Conversions; what cannot be converted is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_integer(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def to_fractional(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def fractional_to_integer(x: Column) -> Column:
    """Towards zero."""
    return x.cast("bigint")


def format_fractional(x: Column, pattern: str = "%.2f") -> Column:
    return F.format_string(pattern, x.cast("double"))


def format_integer(n: Column, pattern: str = "%d") -> Column:
    return F.format_string(pattern, n.cast("bigint"))


def to_text(x: Column) -> Column:
    return x.cast("string")


def enum_label(x: Column, labels: dict[str, str]) -> Column:
    """The label of a code, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), x)


def enum_code(label: Column, labels: dict[str, str]) -> Column:
    return enum_label(label, {v: k for k, v in labels.items()})
