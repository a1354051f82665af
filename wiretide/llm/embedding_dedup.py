"""Near duplicates of vectors by Euclidean p-stable hashing, followed by exact cosine checks.

Unit vectors at cosine 0.98 are 0.2 apart. A table's bucket is the tuple of ``PROJECTIONS`` random projections, shifted
and cut into steps of ``WIDTH``; two vectors at distance c share a projection's step with the probability
``p(c) = 1 - 2 N(-w/c) - 2 c / (w sqrt(2 pi)) (1 - exp(-w^2 / 2 c^2))``, and a bucket of one of the tables with
``1 - (1 - p^PROJECTIONS)^TABLES``. Vectors that share a bucket and a label are compared exactly, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .groups import connected_components, in_cells, smallest_reachable, sorted_groups

COSINE = 0.98
WIDTH, PROJECTIONS, TABLES = 2.0, 12, 12
#: Vectors of a bucket that are compared in one block with each other.
BLOCK = 1024
SEED = 11
CELL = ["label", "dim", "number", "bucket", "low", "high"]


def step_probability(distance: float, width: float = WIDTH) -> float:
    x = width / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def expected_recall(cosine: float = COSINE, width: float = WIDTH, projections: int = PROJECTIONS, tables: int = TABLES) -> float:
    return 1 - (1 - step_probability(math.sqrt(2 - 2 * cosine), width) ** projections) ** tables


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def bucket_hashes(vectors: np.ndarray, width: float, projections: int, tables: int, seed: int) -> np.ndarray:
    """One 64-bit hash of the bucket per unit vector and table; the projections follow from the seed and the dimension."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions = rng.normal(size=(vectors.shape[1], tables * projections))
    shifts = rng.uniform(0, width, tables * projections)
    steps = np.floor((vectors @ directions + shifts) / width).astype(np.int64).astype(np.uint64)
    mix = rng.integers(0, 2**63, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        keys = (steps.reshape(-1, tables, projections) * mix).sum(axis=2, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys.astype(np.int64)


def compare_cell(ids, mult, block, number, hashes, vectors, cosine: float):
    """Per vector: how many rows it is linked to here, and the smallest id it reaches.

    A pair is counted in the first table whose bucket it shares, and in one cell of it.
    """
    units = unit(vectors)
    linked = units @ units.T >= cosine
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    for k in range(number):
        linked &= hashes[:, k, None] != hashes[None, :, k]
    count = linked @ mult
    at = count > 0
    return (ids[at], count[at], smallest_reachable(ids[at], linked[at][:, at])) if at.any() else None


def near_duplicates(
    embeddings: DataFrame,
    cosine: float = COSINE,
    width: float = WIDTH,
    projections: int = PROJECTIONS,
    tables: int = TABLES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with null ids or labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing, nor do
    vectors of different length. Equal vectors are one class, compared once; ``n_links`` counts rows, so a repeated row is one
    link more. Rows of one id share its component. An empty table gives an empty table; other columns are ignored.
    """
    numbers = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), numbers.alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # 128 bits stand for a vector; only ids and these are shuffled.
    same = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "label", "v").alias("h2")]
    hashed = rows.where("usable").select("id", *same)
    classes = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = materialize(classes)

    schema = "id long, label long, dim int, v binary, hashes binary, buckets array<bigint>"

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy() - lists.offsets.to_numpy()[:1].sum()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = flat[starts[at][:, None] + np.arange(dim)]
                hashes = bucket_hashes(unit(vectors), width, projections, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        batch.column(1).take(pa.array(at)),
                        pa.array([dim] * len(at), pa.int32()),
                        pa.array([x.tobytes() for x in vectors], pa.binary()),
                        pa.array([x.tobytes() for x in hashes], pa.binary()),
                        pa.array(hashes.tolist(), pa.list_(pa.int64())),
                    ],
                    names=["id", "label", "dim", "v", "hashes", "buckets"],
                )

    usable_rows = rows.where("usable").select("id", "label", "v", *same)
    # One row of each class: its smallest id, once.
    reps = usable_rows.join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"])
    mult = reps.select("id", "label", "mult")
    vectors = reps.select("id", "label", "v").mapInArrow(bucketed, schema)
    vectors = materialize(vectors.join(mult, ["id", "label"]))
    at = vectors.select("id", "label", "dim", F.posexplode("buckets").alias("number", "bucket"))
    bucket = ["label", "dim", "number", "bucket"]
    shared = at.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    members = in_cells(at.join(shared, bucket), F.ceil(F.col("n") / block), F.col("id")).drop("n")
    cells = members.join(vectors.select("id", "label", "mult", "v", "hashes"), ["id", "label"])
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, CELL):
            n = cell.num_rows
            if n < 2:
                continue
            v = np.frombuffer(b"".join(cell["v"].to_pylist())).reshape(n, -1)
            hashes = np.frombuffer(b"".join(cell["hashes"].to_pylist()), np.int64).reshape(n, -1)
            found = compare_cell(
                cell["id"].to_numpy(), cell["mult"].to_numpy(), cell["block"].to_numpy(), cell["number"][0].as_py(), hashes, v, cosine
            )
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "root"])

    order = [*CELL, "id", "mult", "block", "hashes", "v"]
    found = materialize(dealt.select(*order).mapInArrow(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # A class is one node, by its smallest id; rows of one id with different vectors are one node too.
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    own = classes.join(links, classes["rep"] == links["id"], "left").drop("id")
    own = own.join(components, own["rep"] == components["node"], "left").drop("node")
    mine = usable_rows.select("id", "h1", "h2").join(own, ["h1", "h2"]).select(
        "id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return mine.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
