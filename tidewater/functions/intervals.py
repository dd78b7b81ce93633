"""Times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def jittered(start: Column, end: Column, u: Column) -> Column:
    """A time in [start, end) at a whole number of seconds after start; start itself if end is not later by a second."""
    span = F.floor((micros(end) - micros(start)) / F.lit(1_000_000))
    moved = F.timestamp_add("SECOND", F.floor(u * span).cast("int"), start)
    return F.when(span > 0, moved).otherwise(start)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_ratio(w_start: Column, w_end: Column, a_start: Column, a_end: Column, length: float = 5.0) -> Column:
    """Overlap of a window and an annotation, by the shorter of the window length and the annotation."""
    return overlap(w_start, w_end, a_start, a_end) / F.least(F.lit(length), a_end - a_start)


def window_start(begin: Column, end: Column, duration: Column, u: Column, length: float = 5.0) -> Column:
    """Where a window of `length` around an event starts.

    A short event lies in the window, a long one holds it, u deciding where. The
    window is moved into the recording; a recording shorter than it starts it at 0.
    """
    span = end - begin
    start = F.when(span <= length, begin - u * (F.lit(length) - span)).otherwise(begin + u * (span - F.lit(length)))
    return F.when(duration < length, F.lit(0.0)).otherwise(F.least(F.greatest(start, F.lit(0.0)), duration - F.lit(length)))


def window_end(start: Column, duration: Column, length: float = 5.0) -> Column:
    return F.least(start + F.lit(length), duration)
