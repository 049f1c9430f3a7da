"""Delimited strings as lists; places count from 1, a bad or empty delimiter means a comma."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _delimiter(d: str | None) -> str:
    return d if d and len(d) == 1 else ","


def items(s: Column, d: str | None = ",") -> Column:
    return F.split(s, re.escape(_delimiter(d)), -1)


def entry(i: Column, s: Column, d: str | None = ",") -> Column:
    """The i-th item, null beyond the ends."""
    return F.when(i >= 1, F.try_element_at(items(s, d), i.cast("int")))


def count(s: Column, d: str | None = ",") -> Column:
    return F.size(items(s, d))


def lookup(e: Column, s: Column, d: str | None = ",") -> Column:
    """The place of an item, 0 if absent."""
    return F.array_position(items(s, d), e)


def remove(s: Column, at: Column, n: Column, d: str | None = ",") -> Column:
    """Without n items from place ``at``: a negative n goes to the end, a place outside changes nothing."""
    every = items(s, d)
    size = F.size(every)
    take = F.when((n < 0) | (at + n > size + 1), size - at + 1).otherwise(n)
    kept = F.concat(F.slice(every, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(every, F.greatest(at + take, F.lit(1)), size))
    return F.when((at < 1) | (at > size), s).otherwise(F.array_join(kept, _delimiter(d)))


def sort(s: Column, d: str | None = ",") -> Column:
    return F.array_join(F.array_sort(items(s, d)), _delimiter(d))


def top_level(s: Column) -> Column:
    """The arguments of a call: commas within parentheses or double quotes do not split."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"))

    def step(acc: Column, ch: Column) -> Column:
        quoted = F.when(ch == '"', ~acc["quoted"]).otherwise(acc["quoted"])
        depth = acc["depth"] + F.when(acc["quoted"], 0).when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        splits = (ch == ",") & (acc["depth"] == 0) & ~acc["quoted"]
        return F.struct(
            F.when(splits, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(splits, F.lit("")).otherwise(F.concat(acc["cur"], ch)).alias("cur"),
            depth.alias("depth"),
            quoted.alias("quoted"),
        )

    chars = F.regexp_extract_all(s, F.lit("(?s)."), 0)
    return F.aggregate(chars, start, step, lambda acc: F.when(F.trim(acc["cur"]) != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
