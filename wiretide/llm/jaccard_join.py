"""Near duplicates of texts by Jaccard similarity of word n-grams: MinHash banding, then exact checks on whole n-gram sets.

Texts are cut into words at white space; a text's set holds its runs of five words (all its words, if there are fewer). The
bands are chosen so that a pair at the threshold shares one with the target recall. Band hashes are shuffled; texts
that a chain of shared bands connects form a candidate cluster, and within a cluster every pair of texts is compared on the
full sets, in cells of two blocks, so that no pair is written out and a large cluster is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import pieces
from .groups import connected_components, in_cells, perhaps_among, smallest_reachable, sorted_groups

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions of a signature at most; more rows in a band mean fewer false candidates.
MAX_HASHES = 256
#: Shingles in a block of a cluster; a text counts for at least LEAST_WEIGHT, which bounds the texts in a block.
BLOCK_SHINGLES, LEAST_WEIGHT = 400_000, 400
CACHED_WORDS = 200_000
SEED = 5
CELL = ["cluster", "low", "high"]


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which the bands for the recall at the threshold fit."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


class WordHashes(dict):
    """64-bit hashes by word, of which a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's runs of ``n`` words; empty for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count = max(1, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for k in range(min(n, len(words))):
        total = mixed(total + h[k : k + count] + np.uint64(k + 1))
    return np.unique(total)


def signature_bands(shingles: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the signature; texts without words share them all."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        part = shingles[a : a + 1024, None] * factors[None, :]
        part ^= part >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out + least[k::rows][:bands])
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of ``a``, how many members it shares with each set of ``b``."""
    values = np.concatenate(b) if b else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = values.argsort(kind="stable")
    values, owner = values[order], owner[order]
    for x in a:
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        length = hi - lo
        ends = length.cumsum()
        at = np.repeat(lo - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        yield np.bincount(owner[at], minlength=len(b))


def compare_cell(ids: np.ndarray, mult: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: float):
    """Per text: how many rows it is linked to in this cell, and the smallest id it reaches here."""
    linked = np.zeros((len(ids), len(ids)), bool)
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    for i, both in zip(left, shared_counts([sets[i] for i in left], [sets[j] for j in right]), strict=True):
        either = sizes[i] + sizes[right] - both
        linked[i, right] = (either == 0) | (both / np.maximum(either, 1) >= threshold)
    linked |= linked.T
    np.fill_diagonal(linked, False)
    count = linked @ mult
    at = count > 0
    return (ids[at], count[at], smallest_reachable(ids[at], linked[at][:, at])) if at.any() else None


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, copy_of, group_id, n_links, kept.

    ``copy_of`` is the smallest id with the same text, ``group_id`` the smallest id that links reach, ``n_links`` the number of other
    rows at the threshold or above (copies too), ``kept`` whether the row's id is its group's. Null and empty texts are
    copies of each other, and texts without words are alike. Rows of one id are one node of the groups. Rows with a null id
    link with nothing and are kept; other columns are ignored; an empty table gives an empty table.
    """
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce("text", F.lit("")).cast("binary")
    all_rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("t"))
    # 128 bits stand for a text.
    digests = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")]
    named = all_rows.where("id IS NOT NULL").select("id", *digests, "t")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in pieces(batches):
                sizes, keys = [], []
                for t in batch.column(3).to_pylist():
                    s = shingle_set(t, hashes, n)
                    sizes.append(len(s))
                    keys.append(signature_bands(s, factors, bands, rows).astype(np.int64))
                out = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "h1", "h2", "size", "bands"])

    signed = materialize(named.mapInArrow(sign, "id long, h1 long, h2 long, size long, bands array<bigint>"))
    classes = materialize(signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    reps = signed.join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"])
    # Texts that share a band, as links to the smallest id of the band.
    at = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = at.groupBy("band", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    candidates = at.join(shared.select("band", "key", "first"), ["band", "key"]).where("id <> first")
    clusters = connected_components(candidates.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    sized = reps.select("id", "h1", "h2", "mult", "size").join(clusters.withColumnRenamed("component", "cluster"), F.col("id") == F.col("node"))
    sized = materialize(sized.drop("node"))
    weight = F.greatest(F.col("size"), F.lit(LEAST_WEIGHT))
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum(weight) / BLOCK_SHINGLES).alias("n_blocks"))
    members = in_cells(sized.join(blocks, "cluster"), F.col("n_blocks"), F.col("id"))
    texts = perhaps_among(named, F.col("id"), sized.select("id")).withColumnRenamed("id", "doc")
    same = (F.col("id") == F.col("doc")) & (members["h1"] == texts["h1"]) & (members["h2"] == texts["h2"])
    cells = members.join(texts, same).select(*CELL, "id", "mult", "block", members["h1"].alias("h1"), members["h2"].alias("h2"), "t")
    order = [*CELL, "id", "h1", "h2"]
    dealt = cells.repartition(*CELL).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for cell in sorted_groups(batches, CELL):
            # Repeated rows of a text come once.
            h1, h2, ids = (cell[c].to_numpy() for c in ("h1", "h2", "id"))
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            if new.sum() < 2:
                continue
            cell = cell.filter(pa.array(new))
            with np.errstate(over="ignore"):
                sets = [shingle_set(t, hashes, n) for t in cell["t"].to_pylist()]
            found = compare_cell(cell["id"].to_numpy(), cell["mult"].to_numpy(), cell["block"].to_numpy(), sets, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "root"])

    found = materialize(dealt.mapInArrow(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    own = classes.join(links, classes["rep"] == links["id"], "left").drop("id")
    own = own.join(groups, own["rep"] == groups["node"], "left").drop("node")
    mine = signed.select("id", "h1", "h2").join(own, ["h1", "h2"])
    mine = mine.select(
        F.col("id").alias("doc_id"),
        F.col("rep").alias("copy_of"),
        F.coalesce("component", "rep").alias("group_id"),
        (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    null = F.lit(None).cast("long")
    alone = all_rows.where("id IS NULL").select(null.alias("doc_id"), null.alias("copy_of"), null.alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return mine.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def one_of_each_group(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group of ``docs``, with the columns of ``docs``, whatever their names.

    Groups are those of texts: rows of one text are one class, linked texts are one group, and so are the texts of one id. Rows
    with a null id are classes by their texts like the others. Null and empty texts are one text, and texts without words are alike. A group
    keeps a row of the text with its smallest id (ids that aren't null first); of repeated rows one stays. Texts are compared whole, however
    long; an empty table gives an empty table.
    """
    # Input columns go by their place, so that none can be taken for a column made here.
    own = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"in_{i}") for i, c in enumerate(docs.columns)}
    text = F.coalesce(at["text"], F.lit("")).cast("binary")
    doc_id = at["doc_id"].cast("long")
    hashed = own.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text), "id": doc_id})
    # Each text once, under a number of its own, so that no two texts are taken for one document.
    numbered = materialize(hashed.withColumn("class", F.col("h1").bitwiseXOR(F.col("h2"))))
    classes = materialize(numbered.groupBy("h1", "h2", "class").agg(F.min("id").alias("id")))
    # The text is stored once, as the input's own column.
    texts = numbered.select("h1", "h2", F.col("class").alias("doc_id"), text.cast("string").alias("text")).dropDuplicates(["h1", "h2"]).select("doc_id", "text")
    alike = jaccard_groups(texts, **settings).select(F.col("doc_id").alias("a"), F.col("group_id").alias("b"))
    ids = numbered.where("id IS NOT NULL").select("class", "id").distinct()
    least = ids.groupBy("id").agg(F.min("class").alias("b"), F.count("*").alias("n")).where("n > 1")
    same_id = ids.join(least, "id").select(F.col("class").alias("a"), "b")
    groups = connected_components(alike.union(same_id))
    grouped = classes.join(groups, F.col("class") == F.col("node"), "left")
    grouped = grouped.withColumn("group", F.coalesce("component", "class"))
    # The class with the smallest id; the number decides among classes without an id.
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("class"), F.col("h1"), F.col("h2"))
    chosen = grouped.groupBy("group").agg(F.min(order).alias("first")).select("first.h1", "first.h2", "first.id")
    same = (numbered["h1"] == chosen["h1"]) & (numbered["h2"] == chosen["h2"]) & numbered["id"].eqNullSafe(chosen["id"])
    rows = numbered.join(chosen, same, "left_semi").dropDuplicates(["h1", "h2"])
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
