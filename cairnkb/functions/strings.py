"""String functions as Column -> Column. A null argument gives null unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every character below U+2000 that is an ASCII letter with marks, and that letter.
ACCENTED = "".join(chr(i) for i in range(0x80, 0x2000) if unicodedata.normalize("NFD", chr(i))[0] in _LETTERS)
PLAIN = "".join(unicodedata.normalize("NFD", x)[0] for x in ACCENTED)


def fold_accents(s: Column) -> Column:
    """Without accents, whether a letter holds them or they follow it; other characters beyond ASCII are dropped."""
    return F.regexp_replace(F.translate(s, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def pascal_parts(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[A-Z][a-z0-9]+"), 0)


def char(n: Column) -> Column:
    """The character of a code from 0 to 255, else null."""
    return F.when((n >= 0) & (n <= 255), F.char(n))


def code(s: Column) -> Column:
    return F.ascii(s)


def pad_left(s: Column, n: int, fill: str) -> Column:
    """Right-aligned; longer strings stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_right(s: Column, n: int, fill: str) -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def pad_centre(s: Column, n: int, fill: str) -> Column:
    """Centred; an odd remainder goes to the left."""
    left = F.ceil((n - F.length(s)) / 2).cast("int")
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(F.concat(F.repeat(F.lit(fill), left), s), n, fill))


def fill(s: Column, n: Column) -> Column:
    return F.repeat(s, F.greatest(n, F.lit(0)))


def known(s: Column) -> Column:
    """Null as ''."""
    return F.coalesce(s, F.lit(""))


def index_of(s: Column, target: Column) -> Column:
    """The first place of ``target`` from 1, any case; 0 if absent, 1 for an empty target."""
    return F.call_function("instr", F.lower(s), F.lower(target))


def matches(s: Column, pattern: str, any_case: bool = True) -> Column:
    """Whether the whole string matches."""
    return s.rlike(("(?iu)" if any_case else "") + "^(?:" + pattern + ")$")


def strip(s: Column, where: str, ch: str) -> Column:
    """``ch`` off the left (L), the right (R), both ends (T) or everywhere (A)."""
    return {"L": F.ltrim(s, F.lit(ch)), "R": F.rtrim(s, F.lit(ch)), "T": F.btrim(s, F.lit(ch)), "A": F.replace(s, F.lit(ch), F.lit(""))}[where]


def trimmed(s: Column, chars: str, where: str = "T") -> Column:
    """Any of ``chars`` off the left (L), the right (R) or both ends (T); none of them leaves the string as it is."""
    return s if chars == "" else {"L": F.ltrim, "R": F.rtrim, "T": F.btrim}[where](s, F.lit(chars))


def part(s: Column, start: Column, n: Column) -> Column:
    """``n`` characters from a place counted from 1; '' from a place before the string or for no characters."""
    return F.when((start >= 1) & (n > 0), F.substring(s, start, n)).when(s.isNotNull() & start.isNotNull() & n.isNotNull(), "")


def translated(s: Column, old: str, new: str) -> Column:
    """Each character of ``old`` as that at its place in ``new``, and gone if there is none there."""
    return F.translate(s, old, new)


def xml_escaped(s: Column, quotes: bool = True) -> Column:
    out = F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def fit(s: Column, width: int, first: str = "", rest: str = "") -> Column:
    """Words wrapped to lines of ``width`` characters, prefixes included; a longer word has a line of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.concat(acc["cur"], F.lit(" "), w)
        fits = F.length(longer) <= width
        prefix = F.when(F.size(acc["done"]) == 0, F.lit(first)).otherwise(F.lit(rest))
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), F.concat(prefix, w).alias("cur")))
            .when(fits, F.struct(acc["done"].alias("done"), longer.alias("cur")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), F.concat(F.lit(rest), w).alias("cur")))
        )

    words = F.filter(F.split(s, "[ \\n\\t]+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda acc: F.array_join(F.concat(acc["done"], F.array(F.coalesce(acc["cur"], F.lit("")))), "\n"))


def headline(s: Column, n: int = 50) -> Column:
    """Trimmed; beyond n characters cut, with an ellipsis."""
    t = F.trim(s)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n))), F.lit("…")))


def initials(name: Column) -> Column:
    """Of the first and last word; two letters of a single one; ``?`` for none."""
    parts = F.filter(F.split(F.trim(name), "[ \\t\\n]+"), lambda x: x != "")
    two = F.concat(F.left(F.get(parts, F.lit(0)), F.lit(1)), F.left(F.element_at(parts, -1), F.lit(1)))
    return F.when(F.size(parts) == 0, "?").when(F.size(parts) == 1, F.upper(F.left(F.get(parts, F.lit(0)), F.lit(2)))).otherwise(F.upper(two))


def in_context(question: Column, context: Column) -> Column:
    """The question behind its context in brackets, if there is one."""
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", question).otherwise(F.concat(F.lit("[Context: "), F.trim(context), F.lit("]\n\n"), question))


def compact_count(n: Column) -> Column:
    """``999``, then ``12,4k``; halves of a tenth are rounded up."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.replace(F.format_string("%.1f", n.cast("double") / 1000), F.lit("."), F.lit(",")), F.lit("k")))
