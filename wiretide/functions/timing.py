"""Integer-microsecond time helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_US = 86_400 * MICROS


def window_us(seconds: float, name: str = "window_s") -> int:
    """A positive duration in whole microseconds."""
    us = round(seconds * MICROS)
    if us <= 0:
        raise ValueError(f"{name} must be positive, got {seconds!r}")
    return us


def cooldown_us(seconds: float) -> int:
    """A cooldown in whole microseconds; zero or less never suppresses anything."""
    return max(round(seconds * MICROS), 0)


def slice_start(ts_us: Column, length_us: int | Column) -> Column:
    """Start of the epoch-aligned time slice that holds ``ts_us``."""
    return ts_us - F.pmod(ts_us, (length_us if isinstance(length_us, Column) else F.lit(length_us)).cast("bigint"))


def slice_length(window: int, slice_s: float | None) -> int:
    """Slice length for a sliding window of ``window`` microseconds: by default four windows, at least a minute.

    Where a key is dense, its slices get shorter (``operators.slices``).
    """
    if slice_s is not None:
        return window_us(slice_s, "slice_s")
    return max(4 * window, 60 * MICROS)


# Rows of one key that a slice should hold at most, and the shortest slice.
SLICE_ROWS = 2_000_000
SHORTEST_US = 1000


def dense_slice(df: DataFrame, keys: list[str], length: int, most: int | None = None) -> int:
    """``length``, or a shorter slice in which no key of ``df`` has more than ``most`` rows, from counts of the rows.

    Counting combines before its shuffle. A key with more rows than that in the shortest slice keeps it.
    """
    most = most or SLICE_ROWS
    while True:
        per_slice = df.groupBy(*keys, slice_start(F.col("ts_us"), length)).agg(F.count(F.lit(1)).alias("_n"))
        densest = per_slice.agg(F.max("_n")).first()[0] or 0
        if densest <= most or length <= SHORTEST_US:
            return length
        length = max(length * most // (2 * densest), SHORTEST_US)


def iso_utc(ts_us: Column) -> Column:
    """ISO-8601 text in UTC; the fraction is left out when it is zero."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_us / F.lit(DAY_US)).cast("int"))
    rest = F.pmod(ts_us, F.lit(DAY_US).cast("bigint"))
    seconds = (rest - F.pmod(rest, F.lit(MICROS))) / F.lit(MICROS)
    micro = F.pmod(rest, F.lit(MICROS))
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds / 60) % 60
    secs = seconds.cast("bigint") % 60
    base = F.format_string(
        "%sT%02d:%02d:%02d", day.cast("string"), hours.cast("int"), minutes.cast("int"), secs.cast("int")
    )
    fraction = F.when(micro == 0, F.lit("")).otherwise(F.format_string(".%06d", micro.cast("int")))
    return F.concat(base, fraction, F.lit("+00:00"))
