"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with a lower and an upper score for each document.

Texts are read once: a document's hits (its length and the frequencies of the terms that any item has) are written to the shared
folder, and all statistics come from that table. Then documents are searched shard by shard. A shard sorts each term's documents
by impact; for each item, blocks are read from all its lists in turn. A document's lower score is the sum of what was read of it, and its
upper score adds the next impact of every list in which it was not met. Reading goes on until no unseen document can reach the
item's k-th lower score and every document that still can has equal bounds. The shards' best are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import pieces

TOP = 50
#: Items and terms that one pass over the documents takes; more items take more passes.
BLOCK_ITEMS = 2_000
BLOCK_TERMS = 100_000
#: Documents and hits of a shard at most, but for a single document's.
SHARD_DOCS = 1 << 17
SHARD_HITS = 2_000_000
#: Postings read from a list in the first round; every round reads twice as many.
FIRST_READ = 256
#: Groups in which the shards' best are ranked before the last ranking.
MERGE_GROUPS = 32

_DOC_BITS, _GAIN_BITS = 17, 20
# ASCII capitals become small letters, other ASCII characters but letters and digits become spaces; bytes of other characters stay.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """50 + (50 * n * documents) div total, in whole numbers."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)
    return 50 + 50 * n * documents // total


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class ShardIndex:
    """Impact-sorted lists of one shard: for each term its documents (numbers in the shard) by falling gain, then number."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, found: np.ndarray, tf: np.ndarray, documents: int, total: int):
        """``counts`` says how many of the hits (``found``: terms, ``tf``) each document has."""
        self.n_docs = len(lengths)
        doc = np.repeat(np.arange(self.n_docs), counts)
        norm = length_norm(lengths, documents, total)[doc]
        # Below a million, as the norm is 50 at least.
        gain = 1_000_000_000 * tf // (1000 * tf + 20 * norm)
        key = (found << (_DOC_BITS + _GAIN_BITS)) | (((1 << _GAIN_BITS) - 1 - gain) << _DOC_BITS) | doc
        key.sort()
        self.doc = key & ((1 << _DOC_BITS) - 1)
        self.gain = (1 << _GAIN_BITS) - 1 - (key >> _DOC_BITS & ((1 << _GAIN_BITS) - 1))
        term = key >> (_DOC_BITS + _GAIN_BITS)
        cuts = [0, *(np.flatnonzero(term[1:] != term[:-1]) + 1).tolist(), len(term)] if len(term) else [0]
        self.lists = {int(term[a]): (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def best(self, weights: dict[int, int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of all documents that are among the ``top`` highest scores above 0, ties with the last one too."""
        lists = [(*self.lists[t], w) for t, w in weights.items() if w > 0 and t in self.lists]
        at = [a for a, _, _ in lists]
        bound = np.array([w * int(self.gain[a]) for a, _, w in lists], np.int64)
        lower = np.zeros(self.n_docs, np.int64)
        seen = np.zeros((len(lists), self.n_docs), bool)
        alive = None
        size = FIRST_READ
        while True:
            for k, (_, end, w) in enumerate(lists):
                if at[k] == end:
                    continue
                stop = min(end, at[k] + size)
                doc, gain = self.doc[at[k] : stop], self.gain[at[k] : stop]
                if alive is not None:
                    wanted = alive[doc]
                    doc, gain = doc[wanted], gain[wanted]
                lower[doc] += w * gain
                seen[k, doc] = True
                at[k] = stop
                bound[k] = w * int(self.gain[stop]) if stop < end else 0
            size *= 2
            unseen = int(bound.sum())
            # With fewer than ``top`` documents met, any score above 0 is wanted.
            last = max(1, int(np.partition(lower, -top)[-top]) if self.n_docs >= top else 1)
            near = np.flatnonzero(lower + unseen >= last)
            upper = lower[near] + unseen - bound @ seen[:, near]
            near, upper = near[upper >= last], upper[upper >= last]
            if unseen < last and (upper == lower[near]).all():
                return near, lower[near]
            if unseen < last:
                alive = np.zeros(self.n_docs, bool)
                alive[near] = True


def write_hits(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """A written table, one row per document with at least one term: id, n (all its terms), found and tf (those of the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in pieces(batches):
            number = number or vocabulary.value.get
            keep, n, sizes, found, tf = [], [], [0], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = terms(text)
                if words:
                    hits = Counter(filter(None, map(number, words)))
                    keep.append(row)
                    n.append(len(words))
                    found += hits.keys()
                    tf += hits.values()
                    sizes.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, pa.int32())) for v in (found, tf)]
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["id", "n", "found", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return materialize(rows.mapInArrow(run, "id long, n long, found array<int>, tf array<int>"))


def search_shards(hits: DataFrame, items, top: int, documents: int, total: int) -> DataFrame:
    """Columns number (of the item), id, score, grp: each shard's best. ``items`` is a broadcast list of {term: weight}."""

    def search(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        found, tf = table["found"].chunk(0), table["tf"].chunk(0)
        counts = np.diff(found.offsets.to_numpy())
        flat = [c.flatten().to_numpy().astype(np.int64) for c in (found, tf)]
        index = ShardIndex(table["n"].to_numpy(), counts, *flat, documents, total)
        group = TaskContext.get().partitionId() % MERGE_GROUPS
        ids = table["id"].chunk(0)
        for number, weights in enumerate(items.value):
            at, score = index.best(weights, top)
            if len(at):
                # Ties beyond the last place are left to the smaller ids.
                chosen = pa.table({"id": ids.take(pa.array(at)), "score": score})
                chosen = chosen.sort_by([("score", "descending"), ("id", "ascending")]).slice(0, top)
                n = chosen.num_rows
                columns = [pa.array([number] * n, pa.int32()), chosen["id"].combine_chunks(), chosen["score"].combine_chunks(), pa.array([group] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "id", "score", "grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_hits = [], 0, 0
        for batch in pieces(batches):
            size = len(batch.column(2).flatten())
            if held and (n_docs + batch.num_rows > SHARD_DOCS or n_hits + size > SHARD_HITS):
                yield from search(held)
                held, n_docs, n_hits = [], 0, 0
            held.append(batch)
            n_docs, n_hits = n_docs + batch.num_rows, n_hits + size
        if n_docs:
            yield from search(held)

    return hits.mapInArrow(run, "number int, id long, score long, grp int")


def item_blocks(items: Iterable[tuple]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, terms of each item) of successive blocks of items."""
    ids, found, known = [], [], set()
    for item_id, text in items:
        own = sorted(set(terms(text)))
        if ids and (len(ids) >= BLOCK_ITEMS or len(known) + len(own) > BLOCK_TERMS):
            yield ids, found
            ids, found, known = [], [], set()
        ids.append(item_id)
        found.append(own)
        known.update(own)
    if ids:
        yield ids, found


def search_block(docs: DataFrame, ids: list, found: list[list[bytes]], top: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    # 0 stands for no term.
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in found for t in own}), 1)}
    hits = write_hits(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col)
    documents, total = hits.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    # One row for each term of the block.
    df = {r.term: r.df for r in hits.select(F.explode("found").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = {t: weight(n, documents) for t, n in df.items()}
    asked = [{vocabulary[t]: weights[vocabulary[t]] for t in own if vocabulary[t] in weights} for own in found]
    best = search_shards(hits, spark.sparkContext.broadcast(asked), top, documents, total)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for keys in (["number", "grp"], ["number"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), "number int, item_id long")
    return best.join(F.broadcast(names), "number").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per item and place: item_id, rank (from 1), doc_id, score: the ``top`` documents of highest score above 0.

    Equal scores are ranked by ascending id, a null id last. Null and empty texts have no terms: such a document counts nowhere, such an item
    has no rows, nor has an item without hits. Texts are read whole, however long; each repeated document is ranked by itself, and each
    repeated item is answered by itself; other columns are ignored; empty tables give an empty table. Items are taken in blocks of
    bounded size, each with one pass over the texts.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).cast("long"), F.col(item_text_col)).sort(F.col(item_col), F.col(item_text_col)).toLocalIterator()
    parts = [search_block(docs, ids, found, top, id_col, text_col) for ids, found in item_blocks(rows)]
    parts = [p for p in parts if p is not None]
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty
