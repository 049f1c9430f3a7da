"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power(b: Column, e: Column) -> Column:
    return F.pow(b, e)


def remainder(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_mod(a, b)


def quotient(a: Column, b: Column) -> Column:
    """Whole division towards zero, null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))


def rounded(x: Column, n: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, n)


def truncated(x: Column, n: int = 0) -> Column:
    """Towards zero."""
    scale = float(10**n)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def logarithm(x: Column, base: float | None = None) -> Column:
    """Natural, or to a base; null up to zero."""
    return F.ln(x) if base is None else F.log10(x) if base == 10 else F.log(float(base), x)


def root(x: Column) -> Column:
    """The square root, null below zero."""
    return F.when(x >= 0, F.sqrt(x))


# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def in_words(n: Column) -> Column:
    """A whole number from 0 to 999,999 in English words, else null."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))

    def hundreds(m: Column) -> Column:
        rest = F.pmod(m, F.lit(100))
        low = F.when(rest < 20, F.get(ones, rest.cast("int"))).otherwise(
            F.concat_ws("-", F.get(tens, (F.floor(rest / 10) - 2).cast("int")), F.when(F.pmod(rest, F.lit(10)) > 0, F.get(ones, F.pmod(rest, F.lit(10)).cast("int"))))
        )
        high = F.concat(F.get(ones, F.floor(m / 100).cast("int")), F.lit(" hundred"))
        return F.concat_ws(" ", F.when(m >= 100, high), F.when((rest > 0) | (m == 0), low))

    thousand = F.floor(n / 1000)
    rest = F.pmod(n, F.lit(1000))
    words = F.concat_ws(" ", F.when(n >= 1000, F.concat(hundreds(thousand), F.lit(" thousand"))), F.when((rest > 0) | (n == 0), hundreds(rest)))
    return F.when((n >= 0) & (n <= 999_999), words)
