"""Running sums over long histories, computed slice by slice.

A plain ``sum() OVER (PARTITION BY key ORDER BY ts)`` puts the whole history of
a key in one task. Here each (key, slice) is a window partition of its own. The
sum of all earlier slices enters as one extra carry row, so no partition is
larger than one slice and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

_CARRY = "_is_carry"


def with_carry(df: DataFrame, key: list[str], slice_col: str, delta: str) -> DataFrame:
    """``df`` plus one carry row per (key, slice) whose ``delta`` is the sum over all earlier slices.

    Carry rows have ``_is_carry`` true and NULL in all other columns.
    """
    totals = df.groupBy(*key, slice_col).agg(F.sum(delta).alias(delta))
    # One row per slice of a key: bounded by the time span, not by the traffic.
    earlier = Window.partitionBy(*key).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn(delta, F.coalesce(F.sum(delta).over(earlier), F.lit(0)).cast(df.schema[delta].dataType))
    rows = df.withColumn(_CARRY, F.lit(False))
    return rows.unionByName(carry.withColumn(_CARRY, F.lit(True)), allowMissingColumns=True)


def running_sum(
    df: DataFrame, key: list[str], slice_col: str, order: list[str | Column], delta: str, out: str
) -> DataFrame:
    """Adds ``out``, the sum of ``delta`` over the key's rows up to and including this one.

    Rows are ordered by (``slice_col``, ``order``). The carry row sorts before all others.
    """
    at = Window.partitionBy(*key, slice_col).orderBy(F.desc(_CARRY), *order)
    summed = F.sum(delta).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return with_carry(df, key, slice_col, delta).withColumn(out, summed)


def drop_carry(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(_CARRY)).drop(_CARRY)


def dense_index(df: DataFrame, order: list[str], chunk: Column, out: str, start: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: ``start``, ``start + 1``, ... in ``order`` (for each value of ``by``), numbered chunk by chunk.

    ``chunk`` must not decrease along ``order``. No task sees more than one chunk.
    """
    flagged = df.withColumn("_chunk", chunk).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = drop_carry(running_sum(flagged, by or [], "_chunk", order, "_one", out))
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1)).drop("_chunk", "_one")


# Bits of a row's place inside its partition, as in ``monotonically_increasing_id``.
_PLACE_BITS = 33


def sorted_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in the order of the columns ``order``, which must tell rows apart; written to the scratch folder.

    Rows are cut into ranges of the order and sorted within; a row's number is its place in its range plus the sizes of the ranges before, one
    row each.
    """
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    # The number of the partition and the place in it; read back, rows may be dealt in any way.
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", _PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(offsets, "_part").withColumn(out, F.col("_offset") + place)
    return numbered.drop("_at", "_part", "_offset")
