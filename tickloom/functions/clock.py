"""Exchange clocks (HHMMSSmmm numbers) as integer milliseconds of the day, splits and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clock_to_ms(clock: Column) -> Column:
    """Strict parse: hours under 24, minutes and seconds under 60, else NULL."""
    c = clock.cast("long")
    hh, mm, ss, ms = (c / 10_000_000).cast("long"), (c / 100_000).cast("long") % 100, (c / 1000).cast("long") % 100, c % 1000
    return F.when((c >= 0) & (hh < 24) & (mm < 60) & (ss < 60), ((hh * 60 + mm) * 60 + ss) * 1000 + ms)


def clock_text_to_ms(clock: Column) -> Column:
    """The last nine digits, left-padded with zeros, cut by position; nothing is validated."""
    t = F.lpad(F.right(clock.cast("string"), F.lit(9)), 9, "0")
    part = lambda a, n: F.substring(t, a, n).try_cast("long")
    return ((part(1, 2) * 60 + part(3, 2)) * 60 + part(5, 2)) * 1000 + part(7, 3)


def clock_positive_to_ms(clock: Column) -> Column:
    """Parse of older files: any positive number counts, whatever its parts."""
    c = clock.cast("long")
    h, m, s = (c / 10_000_000).cast("long"), (c / 100_000).cast("long") % 100, (c / 1000).cast("long") % 100
    return F.when(c > 0, ((h * 60 + m) * 60 + s) * 1000 + c % 1000)


def split_of(date: Column, splits: dict[str, tuple[str, str]]) -> Column:
    """The first split whose inclusive range holds the date, else 'out_of_split'."""
    out = None
    for name, (first, last) in splits.items():
        hit = date.between(first, last)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("out_of_split")


def bucket_of_day(t_ms: Column, seconds: int) -> Column:
    last = -(-86_400 // seconds) - 1
    return F.least(F.greatest(F.floor(t_ms / (seconds * 1000)), F.lit(0)), F.lit(last)).cast("int")
