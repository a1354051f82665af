"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the ``K`` smallest distinct 64-bit hashes of a text's shingles of five words (of all
its words, if there are fewer). Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and
the number of distinct shingles. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

SHINGLE = 5
K = 128
#: Parts of the order of ids, for each shuffle partition; a part is sorted in one task.
PARTS_PER_PARTITION = 4


def sketch(words: Column, k: int = K, n: int = SHINGLE) -> Column:
    """From an array of words. No words give an empty sketch."""
    last = F.size(words) - n
    at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    # get() is null past the end, and hashes skip nulls: short texts are one shingle.
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(bottom(hashes, k))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; exact up to ``k`` shingles in both together. 1 for two empty texts."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_parts(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """Per ``key``, the sketch of all its parts. Ranks are cut before the shuffle, so a key may have any number of parts."""
    hashes = sketches.select(F.col(key).alias("key"), F.explode(column).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("hash"))).where(F.col("rank") <= k)
    merged = ranked.groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias("m"))
    keys = sketches.select(F.col(key).alias("key")).distinct()
    empty = F.array().cast("array<bigint>")
    return keys.join(merged, keys["key"].eqNullSafe(merged["key"]), "left").select(keys["key"].alias(key), F.coalesce("m", empty).alias(column))


def as_text(a: Column) -> Column:
    """The sketch written as text: base64 of its hashes, 8 bytes each. Equal texts have equal ones."""
    written = F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))
    return F.translate(written, "\r\n", "")


def order_part(value: Column, cuts: list) -> Column:
    """Number of the ascending ``cuts`` below ``value``, found in two steps of about the root of their number each."""
    if not cuts:
        return F.lit(0)
    size = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    below = lambda values: F.size(F.filter(values, lambda c: c < value))
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    return F.when(group == 0, 0).otherwise((group - 1) * size + below(F.get(inner, group - 1)))


def with_next(base: DataFrame, prepare: Callable[[DataFrame], DataFrame], id_col: str, lead: list[str]) -> DataFrame:
    """``prepare(base)`` with ``next``, a struct of the ``lead`` columns of the row that follows in ascending order of ``id_col``.

    ``prepare`` makes the ``lead`` columns row by row.
    After the last row comes the first. Rows are cut into parts of the order at estimated quantiles, so rows are shuffled once and
    no task sorts more than a part; a copy of each part's first row is put behind the part before. Null ids come first; equal ids
    are ordered by the first of the ``lead`` columns.
    """
    spark = base.sparkSession
    n_parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One array of n_parts ids comes to the driver.
    cuts = base.agg(F.percentile_approx(id_col, [i / n_parts for i in range(1, n_parts)], 20 * n_parts)).first()[0] or []
    part = F.when(F.col(id_col).isNull(), 0).otherwise(order_part(F.col(id_col), sorted(set(cuts))))
    value = F.struct(*lead)
    placed = prepare(base).withColumn("part", part).withColumn("copy", F.lit(False))
    # The first id of each part and the part before it in the ring: a row of numbers for each part.
    rank = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("value"))
    first_ids = base.select(rank.alias("f"), part.alias("part")).groupBy("part").agg(F.min("f").alias("f"))
    ring = Window.orderBy("part")
    last = F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.lag("part").over(ring), last)
    first_ids = first_ids.select(before.alias("before"), F.col("f.value").alias("first_id"))
    same = base[id_col].eqNullSafe(first_ids["first_id"])
    heads = prepare(base.join(F.broadcast(first_ids), same)).groupBy("before").agg(F.min_by(value, lead[0]).alias("v"))
    copies = heads.select(F.col("before").alias("part"), F.lit(True).alias("copy"), "v.*")
    inside = Window.partitionBy("part").orderBy("copy", F.col(id_col).asc_nulls_first(), lead[0])
    led = placed.unionByName(copies, allowMissingColumns=True).withColumn("next", F.lead(value).over(inside))
    return led.where("NOT copy").drop("part", "copy")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, kept_share.

    ``n_shingles`` estimates the number of the text's distinct shingles, ``kept_share`` the share of them that the edited text has too.

    The edited text has the last quarter of the characters replaced by as many first ones of the next document, in ascending
    order of doc_id. Null texts are empty, and texts are taken whole, however long; the fingerprint of an empty text is the empty string, and two of them are alike (1). A table of
    one row follows itself. Repeated rows follow each other; other columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))

    # Words and edited texts are columns of their own, as what follows refers to them again and again.
    def prepare(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c != "first_id"]
        return rows.withColumn("w", words_of(F.col("t"))).select(*kept, sketch(F.col("w"), k).alias("own"))

    led = with_next(docs.select("doc_id", text.alias("t")), prepare, "doc_id", ["t", "own"])
    n = F.length("t")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - cut), F.substring(F.col("next.t"), F.lit(1), cut))
    edits = led.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), edited.alias("e"))
    edits = edits.withColumn("sha", F.sha2("e", 256)).withColumn("w", words_of(F.col("e")))
    sketched = edits.select("doc_id", "n_chars", "sha", "own", "after", sketch(F.col("w"), k).alias("other"))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("after"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
        containment(F.col("own"), F.col("other"), k).alias("kept_share"),
    )
