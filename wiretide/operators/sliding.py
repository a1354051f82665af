"""Sliding row and distinct counts per key over the closed frame ``[ts - W, ts]``.

Only rows that arrived up to the current one (order ``ts_us, seq``) count, so a
plain RANGE frame, which also takes in later peers with the same time, is not
enough. Both counts are written as

    rows that came alive so far  -  rows that have expired by now

where the second term is a growing frame (``UNBOUNDED PRECEDING`` up to
``ts - W - 1``). Spark extends growing frames in place, so the cost per row
does not depend on how many rows the window holds, unlike a sliding frame.

Layout. Time is cut into slices of four windows, and one shuffle on (key, slice) brings each slice the rows it needs, so a
key is spread over as many tasks as it has slices. A slice also sees rows of the slice before; those are sent to both, so
a row is written twice at most. A dense key has slices of its own, shorter where it is dense. There a window may reach over many, so a distinct
count gets one marker row per value that is still live when the slice starts, with its latest time, and a row count gets each expiry sent to the
slice where it falls due, plus the count at the start of the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.timing import slice_length, slice_start, window_us
from ..scratch import materialize
from .running import drop_carry, running_sum
from .slices import SLICE as _SLICE
from .slices import cut, dense_keys

_OWN = "_own"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _visible_slices(ts: Column, window: int, length: int) -> Column:
    own = slice_start(ts, length)
    last = slice_start(ts + F.lit(window), length)
    return F.explode(F.when(own == last, F.array(own)).otherwise(F.array(own, last)))


def _with_halo(df: DataFrame, key: list[str], window: int, length: int) -> DataFrame:
    """Each row in its slice, and once more in the next slice if that can see it; ``_own`` tells the first from the second."""
    ts = F.col("ts_us")
    own = slice_start(ts, length)
    return df.select("*", _visible_slices(ts, window, length).alias(_SLICE)).withColumn(_OWN, F.col(_SLICE) == own)


def _changes(df: DataFrame, window: int) -> DataFrame:
    """Each row as an arrival and an expiry, at ``_at``; the running sum of ``_delta`` is the live count."""
    ts, one = F.col("ts_us"), F.lit(1).cast("bigint")
    return df.select(
        "*", F.inline(F.array(F.struct(ts.alias("_at"), one.alias("_delta")), F.struct((ts + F.lit(window)).alias("_at"), (-one).alias("_delta"))))
    )


def _count_with_carry(changes: DataFrame, key: list[str], out: str) -> DataFrame:
    # An expiry takes effect after the arrivals at the same instant: the frame is closed.
    counted = running_sum(changes, key, _SLICE, ["_at", F.desc("_delta"), "seq"], "_delta", out)
    return drop_carry(counted.filter(F.col("_delta") == 1)).drop(_SLICE, "_at", "_delta")


def _with_live_values(rows: DataFrame, key: list[str], value: str, window: int, reach: int) -> DataFrame:
    """``rows`` (with their ``_slice``) plus, per slice, the latest earlier occurrence of each value still live at its start.

    A window that ends in a slice starts at most ``reach`` microseconds before the slice. The aggregate behind the markers combines before its
    shuffle and has one row per (key, value, slice); a marker enters the key's later slices up to its expiry or the next slice with the value.
    """
    latest = rows.groupBy(*key, value, _SLICE).agg(F.max("ts_us").alias("ts_us"))
    # One row per slice of a key.
    in_order = Window.partitionBy(*key).orderBy(_SLICE)
    slices = rows.select(*key, _SLICE).distinct().withColumn("_number", F.row_number().over(in_order))
    ahead = F.count(F.lit(1)).over(in_order.rangeBetween(1, reach))
    slices = materialize(slices.withColumn("_ahead", ahead))
    numbered = latest.join(slices, [*key, _SLICE])
    upcoming = F.lead("_number").over(Window.partitionBy(*key, value).orderBy("_number"))
    until = F.least(F.col("_number") + F.col("_ahead"), upcoming)
    entered = numbered.withColumn("_until", until).filter(F.col("_until") > F.col("_number"))
    markers = entered.select(*key, value, "ts_us", F.explode(F.sequence(F.col("_number") + 1, F.col("_until").cast("int"))).alias("_number"))
    markers = markers.join(slices.drop("_ahead"), [*key, "_number"]).filter(F.col(_SLICE) <= F.col("ts_us") + F.lit(window))
    both = rows.withColumn(_OWN, F.lit(True)).unionByName(markers.drop("_number"), allowMissingColumns=True)
    return both.withColumn(_OWN, F.coalesce(_OWN, F.lit(False)))


def sliding_count(
    df: DataFrame,
    key: str | list[str],
    window_s: float,
    slice_s: float | None = None,
    out: str = "observed",
    longest: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Adds ``out``: the key's rows in ``[ts_us - W, ts_us]`` that arrived up to this one.

    ``slice_s`` sets one slice length for all keys; ``longest`` is a bound of any key's rows, where one is known;
    ``most`` is what a slice should hold at most.
    """
    keys, window = _keys(key), window_us(window_s)
    length = slice_length(window, slice_s)
    if slice_s is not None:
        if window <= length:
            return _count_with_halo(df, keys, window, length, out)
        return _count_with_carry(_changes(df, window).withColumn(_SLICE, slice_start(F.col("_at"), length)), keys, out)
    most = most or timing.SLICE_ROWS
    dense = dense_keys(df, keys, length, most, longest)
    if dense is None:
        return _count_with_halo(df, keys, window, length, out)
    sparse = _count_with_halo(df.join(dense, keys, "left_anti"), keys, window, length, out)
    changes = cut(_changes(df.join(dense, keys, "left_semi"), window), keys, "_at", length, most)
    return sparse.unionByName(_count_with_carry(changes, keys, out))


def _count_with_halo(df: DataFrame, keys: list[str], window: int, length: int, out: str) -> DataFrame:
    laid = _with_halo(df, keys, window, length).repartition(*keys, _SLICE)
    part = Window.partitionBy(*keys, _SLICE)
    expired = part.orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(window + 1))
    counted = laid.withColumn("_arrived", F.row_number().over(part.orderBy("ts_us", "seq"))).withColumn(
        out, F.col("_arrived") - F.count(F.lit(1)).over(expired)
    )
    return counted.filter(_OWN).drop("_arrived", _SLICE, _OWN)


def sliding_distinct_count(
    df: DataFrame,
    key: str | list[str],
    value: str,
    window_s: float,
    slice_s: float | None = None,
    out: str = "observed",
    longest: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Adds ``out``: distinct values of the key whose latest arrival lies in ``[ts_us - W, ts_us]``.

    A value comes alive when its previous occurrence has already expired and
    goes when no later occurrence keeps it alive. ``slice_s``, ``longest`` and ``most`` as for ``sliding_count``.
    """
    keys, window = _keys(key), window_us(window_s)
    length = slice_length(window, slice_s)
    if slice_s is not None:
        if window <= length:
            laid = _with_halo(df, keys, window, length)
        else:
            rows = df.withColumn(_SLICE, slice_start(F.col("ts_us"), length))
            laid = _with_live_values(rows, keys, value, window, length + window)
        return _count_live(laid, keys, value, window, out)
    most = most or timing.SLICE_ROWS
    dense = dense_keys(df, keys, length, most, longest)
    if dense is None:
        return _count_live(_with_halo(df, keys, window, length), keys, value, window, out)
    sparse = _with_halo(df.join(dense, keys, "left_anti"), keys, window, length)
    cut_rows = cut(df.join(dense, keys, "left_semi"), keys, "ts_us", length, most)
    live = _with_live_values(cut_rows, keys, value, window, length + window)
    return _count_live(sparse.unionByName(live), keys, value, window, out)


def _count_live(laid: DataFrame, keys: list[str], value: str, window: int, out: str) -> DataFrame:
    laid = laid.repartition(*keys, _SLICE)
    ts, part = F.col("ts_us"), Window.partitionBy(*keys, _SLICE)
    occurrences = Window.partitionBy(*keys, _SLICE, value).orderBy("ts_us", "seq")
    arrived = part.orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expired = part.orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(window + 1))
    seen = laid.withColumn("_before", F.lag("ts_us").over(occurrences)).withColumn(
        "_after", F.lead("ts_us").over(occurrences)
    )
    flagged = seen.withColumn(
        "_start", F.coalesce((F.col("_before") < ts - F.lit(window)).cast("int"), F.lit(1))
    ).withColumn("_end", F.coalesce((F.col("_after") > ts + F.lit(window)).cast("int"), F.lit(1)))
    counted = flagged.withColumn("_live", F.sum("_start").over(arrived)).withColumn(
        out, F.col("_live") - F.coalesce(F.sum("_end").over(expired), F.lit(0))
    )
    return counted.filter(_OWN).drop("_live", "_start", "_end", "_before", "_after", _SLICE, _OWN)
