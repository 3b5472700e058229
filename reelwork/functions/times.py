"""Half-open millisecond intervals, MM:SS text and presentation time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mmss_to_ms(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.when(text.rlike(r"^\d{2,}:[0-5]\d$"), (parts[0].cast("long") * 60 + parts[1].cast("long")) * 1000)


def ms_to_mmss(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60).cast("long")
    tail = F.lpad((seconds - minutes * 60).cast("long").cast("string"), 2, "0")
    return F.concat(F.when(minutes < 10, F.lpad(minutes.cast("string"), 2, "0")).otherwise(minutes.cast("string")), F.lit(":"), tail)


def pts_to_ms(pts: Column, start: Column | int, num: Column, den: Column) -> Column:
    """Milliseconds of a time stamp from the stream's start, exact, halves to even."""
    start = start if isinstance(start, Column) else F.lit(start)
    n = (pts - start).cast("long") * num * 1000
    rest = F.pmod(n, den)
    whole = ((n - rest) / den).cast("long")
    up = (2 * rest > den) | ((2 * rest == den) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + up.cast("long")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_b < end_a) & (end_b > start_a)
