"""What the near-duplicate operators share: cells of large groups, groups within sorted tasks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Bits of the array that thins out rows before a join (8 MB), and of one piece of it.
FILTER_BITS = 1 << 26
_PIECE = 1 << 15


def in_cells(members: DataFrame, n_blocks: Column, member: Column) -> DataFrame:
    """Deals each group's members into blocks and the blocks into cells of two, with columns block, low and high.

    Every pair of members meets in exactly one cell: a pair of one block in (b, b), others in (low, high). A cell has at most
    two blocks, so the work on a large group is spread and none of it is left out.
    """
    blocked = members.withColumn("n_blocks", n_blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(member, F.lit("block")), F.col("n_blocks")).cast("int")
    )
    others = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return others.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "n_blocks")


def perhaps_among(rows: DataFrame, row_id: Column, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose id may be among the ids (column id): all that are, and few others as long as ``bits`` is well above their number.

    A bit array of fixed size, in pieces of 4 KB, is broadcast, so wide rows needn't be shuffled to a join that drops them.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    pieces = ids.select(place(F.col("id")).alias("p")).groupBy((F.col("p") / _PIECE).cast("int").alias("piece"))
    pieces = pieces.agg(F.bitmap_construct_agg(F.col("p") % _PIECE).alias("bitmap"))
    at = rows.withColumn("_place", place(row_id))
    joined = at.join(F.broadcast(pieces), (F.col("_place") / _PIECE).cast("int") == F.col("piece"))
    bit = F.col("_place") % _PIECE
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    masks = F.array(*[F.lit(1 << k) for k in range(8)])
    return joined.where(byte.bitwiseAND(F.get(masks, (bit % 8).cast("int"))) > 0).select(*rows.columns)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of equal ``key`` columns, from batches that are sorted by them."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([carry, table]).combine_chunks() if carry is not None else table
        new = np.zeros(table.num_rows - 1, bool)
        for name in key:
            column = table[name].to_numpy()
            new |= column[1:] != column[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)
        carry = table.slice(starts[-1])
    if carry is not None:
        yield carry


def smallest_reachable(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row of the symmetric matrix ``linked``, the smallest id of its connected component."""
    labels = ids.copy()
    most = np.iinfo(np.int64).max
    while True:
        best = np.minimum(labels, np.where(linked, labels[None, :], most).min(axis=1, initial=most))
        if (best == labels).all():
            return labels
        labels = best


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) for the nodes of ``edges`` (a, b: long).

    Alternates the large-star and the small-star step until nothing changes, each a combining aggregate and a join; each
    round's edges are written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
