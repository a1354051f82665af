"""Time slices of a key that get shorter where the key is dense.

Most keys are cut into slices of one length. A key with more rows than that in some slice is dense: there its time is
cut finer, until no piece holds too many rows, and neighbouring pieces are put together again as long as they stay below
the bound. So a burst has many short slices and the quiet time around it keeps long ones, whatever other keys do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import slice_start
from ..scratch import materialize

SLICE = "_slice"
_BROAD, _FINE, _STEP = "_broad", "_fine", "_step"


def dense_keys(df: DataFrame, keys: list[str], length: int, most: int, longest: int | None = None) -> DataFrame | None:
    """The keys of which some slice of ``length`` holds more than ``most`` rows, or None without any.

    ``longest`` is a bound of any key's rows, where one is known. There are fewer dense keys than rows / ``most``.
    """
    if (df.count() if longest is None else longest) <= most:
        return None
    counts = df.groupBy(*keys, slice_start(F.col("ts_us"), length)).agg(F.count(F.lit(1)).alias("_n"))
    found = materialize(counts.filter(F.col("_n") > most).select(*keys).distinct())
    return None if found.isEmpty() else found


def crowded_keys(per_slice: DataFrame, keys: list[str], window: int, least: int) -> tuple[DataFrame, int]:
    """The keys that may hold ``least`` things in a window: (keys, ``_rows``), written out, and the most rows of any of them.

    ``per_slice`` has a row per key and slice of the window's length: ``_slice``, ``_n`` things and ``_rows`` rows. A window
    touches two adjacent slices.
    """
    in_order = Window.partitionBy(*keys).orderBy(SLICE)
    adjacent = F.lag(SLICE).over(in_order) == F.col(SLICE) - F.lit(window)
    both = F.col("_n") + F.when(adjacent, F.lag("_n").over(in_order)).otherwise(0)
    found = per_slice.withColumn("_both", both).groupBy(*keys).agg(F.max("_both").alias("_both"), F.sum("_rows").alias("_rows"))
    found = materialize(found.filter(F.col("_both") >= least).select(*keys, "_rows"))
    first = found.select("_rows").sort(F.desc("_rows")).head()
    return found, first[0] if first else 0


def _piece_counts(rows: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Rows of each piece, for rows with ``_broad`` and ``_step``."""
    return rows.groupBy(*keys, _BROAD, _STEP, slice_start(at, F.col(_STEP)).alias(_FINE)).agg(F.count(F.lit(1)).alias("_n"))


def cut(rows: DataFrame, keys: list[str], at: str, length: int, most: int) -> DataFrame:
    """``rows`` with ``_slice``, the start of a slice of their key's time (column ``at``).

    A slice is one of ``length``, or a part of it with at most twice ``most`` rows; a single microsecond isn't parted. Meant for dense keys:
    all intermediate tables have a row per key and slice of ``length``, or per piece where the key is dense.
    """
    time = F.col(at)
    broad = rows.withColumn(_BROAD, slice_start(time, length))
    counts = materialize(broad.groupBy(*keys, _BROAD).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(float(length) * most / 8) / F.col("_n")).cast("bigint"))
    todo = counts.select(*keys, _BROAD, step.alias(_STEP))
    settled = None
    while True:
        pieces = materialize(_piece_counts(broad.join(todo, [*keys, _BROAD]), keys, time))
        worst = pieces.groupBy(*keys, _BROAD).agg(F.max("_n").alias("_max"))
        again = worst.filter(F.col("_max") > most).select(*keys, _BROAD, "_max")
        finer = pieces.filter(F.col(_STEP) > 1).select(*keys, _BROAD, _STEP).distinct().join(again, [*keys, _BROAD])
        shorter = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col(_STEP) * (most / 4) / F.col("_max")).cast("bigint"))
        finer = materialize(finer.select(*keys, _BROAD, shorter.alias(_STEP)))
        kept = pieces.join(finer.select(*keys, _BROAD), [*keys, _BROAD], "left_anti")
        settled = kept if settled is None else settled.unionByName(kept)
        if finer.isEmpty():
            break
        todo = finer
    # Neighbouring pieces together, as long as they start within the same multiple of ``most`` rows.
    before = Window.partitionBy(*keys, _BROAD).orderBy(_FINE).rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / most).alias("_group")
    grouped = settled.select(*keys, _BROAD, _STEP, _FINE, group)
    first = F.greatest(F.min(_FINE).over(Window.partitionBy(*keys, _BROAD, "_group")), F.col(_BROAD))
    starts = materialize(grouped.select(*keys, _BROAD, _STEP, _FINE, first.alias("_from")))
    steps = starts.select(*keys, _BROAD, _STEP).distinct()
    placed = broad.join(steps, [*keys, _BROAD], "left").withColumn(_FINE, slice_start(time, F.col(_STEP)))
    placed = placed.join(starts.drop(_STEP), [*keys, _BROAD, _FINE], "left")
    return placed.withColumn(SLICE, F.coalesce("_from", F.col(_BROAD))).drop(_BROAD, _FINE, _STEP, "_from")
