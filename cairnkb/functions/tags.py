"""``Tag=Value`` lists and labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import _delimiter, items


def _name(x: Column) -> Column:
    return F.lower(F.substring_index(x, "=", 1))


def extract(s: Column, tag: str, d: str | None = ",") -> Column:
    """The value of a tag, any case; null if absent."""
    found = F.get(F.filter(items(s, d), lambda x: F.contains(x, F.lit("=")) & (_name(x) == tag.lower())), F.lit(0))
    return F.substring(found, F.lit(len(tag) + 2), F.length(found))


def put(s: Column, tag: str, value: Column, d: str | None = ",", longest: int = 64) -> Column:
    """With the tag's value replaced, or the tag appended; values are cut to ``longest``."""
    new = F.concat(F.lit(tag + "="), F.left(value, F.lit(longest)))
    every = items(s, d)
    has = F.exists(every, lambda x: F.contains(x, F.lit("=")) & (_name(x) == tag.lower()))
    replaced = F.transform(every, lambda x: F.when(F.contains(x, F.lit("=")) & (_name(x) == tag.lower()), new).otherwise(x))
    sep = _delimiter(d)
    return F.when(has, F.array_join(replaced, sep)).when(s == "", new).otherwise(F.concat(s, F.lit(sep), new))


def range_label(x: Column, ranges: str) -> Column:
    """Of ``"t:label,t:label"`` in rising order, the label of the greatest t that is at most x; null below all."""
    out = F.lit(None).cast("string")
    for part in ranges.split(","):
        threshold, label = part.split(":", 1)
        out = F.when(x >= float(threshold), F.lit(label)).otherwise(out)
    return out
