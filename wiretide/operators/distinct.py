"""Cumulative distinct values per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.timing import dense_slice, slice_start, window_us
from .running import drop_carry, running_sum

HOUR_US = 3_600_000_000
_SLICE = "_slice"


def first_arrivals(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """One row per (key, value) with the ``ts_us`` and ``seq`` of its first arrival, and the number of its rows."""
    keys = [key] if isinstance(key, str) else key
    first, rows = F.min(F.struct("ts_us", "seq")).alias("_first"), F.count(F.lit(1)).alias("_rows")
    return df.groupBy(*keys, value).agg(first, rows).select(*keys, value, "_first.ts_us", "_first.seq", "_rows")


def cumulative_distinct(
    df: DataFrame,
    key: str | list[str],
    value: str,
    slice_s: float | None = None,
    out: str = "observed",
    first_seen: str = "first_seen",
    firsts: DataFrame | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Adds the running number of distinct values of the key and a flag on the first row of each value.

    First arrivals come from a combining aggregate. Each joins its slice as a
    marker row just before the packet itself, so neither a hot key nor a hot
    (key, value) pair has to fit in one task. ``firsts`` gives the first arrivals
    where they are already known, and ``longest`` a bound of any key's rows. A slice is an hour, or less where a key is dense.
    """
    keys = [key] if isinstance(key, str) else key
    if slice_s is not None:
        length = window_us(slice_s, "slice_s")
    else:
        length = HOUR_US if longest is not None and longest <= timing.SLICE_ROWS else dense_slice(df, keys, HOUR_US)
    start = slice_start(F.col("ts_us"), length).alias(_SLICE)
    marker = F.col("_kind") == 0
    firsts = first_arrivals(df, keys, value) if firsts is None else firsts
    markers = firsts.drop("_rows").select(
        "*", start, F.lit(0).alias("_kind"), F.lit(1).cast("bigint").alias("_new")
    )
    rows = df.select("*", start, F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_new"))
    order = ["ts_us", "seq", "_kind"]
    counted = running_sum(rows.unionByName(markers, allowMissingColumns=True), keys, _SLICE, order, "_new", out)
    at = Window.partitionBy(*keys, _SLICE).orderBy(F.desc("_is_carry"), *order)
    flagged = counted.withColumn(first_seen, F.coalesce(F.lag(marker).over(at), F.lit(False)))
    return drop_carry(flagged.filter(F.col("_kind") == 1)).drop(_SLICE, "_kind", "_new")
