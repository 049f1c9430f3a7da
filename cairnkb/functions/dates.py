"""Date and time functions. Clocks are arguments, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strftime codes and the pattern letters they stand for; short French day names, Monday first.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
DAYS = "lun mar mer jeu ven sam dim".split()


def combine(day: Column, seconds: Column) -> Column:
    """A date and the seconds of its day as a timestamp."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def years_between(a: Column, b: Column) -> Column:
    """Years from b to a with a fraction, by months of 31 days (our choice)."""
    return F.months_between(a, b) / 12


def formatted(t: Column, pattern: str) -> Column:
    """By strftime codes; ``%a`` is the short French day."""
    days = F.get(F.array(*map(F.lit, DAYS)), F.weekday(t))
    parts = []
    for i, piece in enumerate(pattern.split("%a")):
        if i:
            parts.append(days)
        for code, letters in CODES.items():
            piece = piece.replace(code, f"\0{letters}\0")
        texts = piece.split("\0")
        parts += [F.date_format(t, x) if j % 2 else F.lit(x) for j, x in enumerate(texts) if x]
    return F.concat(*parts)


def to_day(s: Column) -> Column:
    """From DD/MM/YYYY; null if it is none."""
    return F.try_to_date(s, "dd/MM/yyyy")


def to_seconds(s: Column) -> Column:
    """From HH:MM or HH:MM:SS to the seconds of the day; null if it is none."""
    ok = s.rlike("^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$")
    part = lambda i: F.coalesce(F.get(F.split(s, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(ok, part(0) * 3600 + part(1) * 60 + part(2))


def bucket(t: Column, today: Column) -> Column:
    """Where a list sorted by date puts a day: today, yesterday, the seven days before today, older."""
    day = t.cast("date")
    return F.when(day >= today, "today").when(day >= F.date_sub(today, 1), "yesterday").when(day >= F.date_sub(today, 7), "last 7 days").otherwise("older")


def last_active(t: Column, today: Column) -> Column:
    gone = F.datediff(today, t.cast("date"))
    return F.when(t.isNull(), "never").when(gone <= 0, "today").when(gone == 1, "yesterday").otherwise(F.concat(gone.cast("string"), F.lit(" d ago")))


def dated_identifier(prefix: str, day: Column, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.lpad(number.cast("string"), 4, "0"))


#: Days of a calendar that are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_DAYS = 100_000


def with_holiday(rows: DataFrame, at: str, calendar: DataFrame, name: str = "holiday") -> DataFrame:
    """``rows`` with ``name``: whether the day of ``at`` is among the days of ``calendar(day)``; false for no day.

    Repeated days of the calendar count once, null ones for nothing. ``name`` must be no column of ``rows``.
    """
    days = calendar.select(F.to_date("day").alias(f"{name}_day")).filter(F.col(f"{name}_day").isNotNull()).distinct()
    few = F.broadcast if days.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else lambda x: x
    joined = rows.join(few(days), F.to_date(rows[at]) == days[f"{name}_day"], "left")
    return joined.select(*[rows[c] for c in rows.columns], days[f"{name}_day"].isNotNull().alias(name))
