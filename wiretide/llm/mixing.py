"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

All of it is DataFrame operations. A source's target is ``min(cap * its size, level * its weight)``; the level is where the
targets add up to the budget, found by going through the sources in the order in which they reach their cap, which is what
clamping and resharing the excess until none is above comes to. A target of ``e`` times the source's size is
``floor(e)`` whole repetitions, and for the rest documents in a seeded random order until the words are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Weights by the sources' order, repeating; share of all sizes that the mix has; most repetitions of a source.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
SEED = 20


def word_count(parts: Column) -> Column:
    """Number of words, from the text split at white space. Only the first and the last part can be empty."""
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return (F.size(parts) - ends).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From one row per source (source_key, source_null, source_size): with weight and target.

    The two windows below have one partition, of one row per source.
    """
    by_name = Window.orderBy("source_null", F.col("source_key").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    reach = Window.orderBy(F.col("source_size") / F.col("weight"), "position")
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    weighed = sizes.withColumn("position", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    # The level if exactly the sources before this one are clamped; the first source that stays below its cap sets it.
    up_to = F.sum("source_size").over(reach) - F.col("source_size")
    above = F.sum("weight").over(everything) - (F.sum("weight").over(reach) - F.col("weight"))
    levels = weighed.withColumn("level", (budget - cap * up_to) / above).withColumn("ceiling", cap * F.col("source_size"))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct("position_in_reach", "level"))).over(everything)
    levels = levels.withColumn("position_in_reach", F.row_number().over(reach)).withColumn("open", open_level["level"])
    target = F.least(F.col("ceiling").cast("double"), F.coalesce(F.col("open") * F.col("weight"), F.col("ceiling").cast("double")))
    return levels.select("source_key", "source_null", "source_size", "weight", target.alias("target"))


def _mix(docs: DataFrame, weights, share: float, cap: int, seed: int) -> DataFrame:
    """The input's columns as in_0, in_1, ..., then size, source_size, target, repetitions, taken."""
    if not 0 < share <= cap:
        raise ValueError("the share can't be above the cap on repetitions")
    inputs = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    kept = [f"in_{i}" for i in range(len(docs.columns))]
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("")), F.lit(seed))
    rows = docs.select(
        *inputs,
        F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.col("source").isNull().alias("source_null"),
        F.md5(name).alias("key"),
        # A column of its own, as the count refers to it again and again.
        F.split(F.coalesce("text", F.lit("")), SPACE_CLASS).alias("parts"),
    )
    # 256 parts of each source's random order, so that a large source isn't sorted in one task.
    sized = rows.select(*kept, "id", "source_key", "source_null", "key", word_count(F.col("parts")).alias("size"))
    sized = sized.withColumn("part", F.substring("key", 1, 2))
    by = ["source_key", "source_null"]
    part_sizes = sized.groupBy(*by, "part").agg(F.sum("size").alias("part_size"))
    sources = part_sizes.groupBy(*by).agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    before = F.sum("part_size").over(Window.partitionBy(*by).orderBy("part")) - F.col("part_size")
    # One row per source and part: as long as the number of sources, whatever the number of documents.
    plan = part_sizes.withColumn("before", before).join(targets, by).select(*by, "part", "before", "source_size", "target")
    in_part = Window.partitionBy(*by, "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(in_part) - F.col("size") / 2
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("epochs")
    extra = (F.col("middle") < (F.col("epochs") - whole) * F.col("source_size")) & (F.col("size") > 0)
    mixed = sized.join(plan, [*by, "part"]).withColumn("middle", middle).withColumn("epochs", epochs)
    mixed = mixed.withColumn("repetitions", (whole + extra.cast("long")).cast("long"))
    return mixed.select(*kept, "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per input row: its columns, and size, source_size, target, repetitions, taken (size times repetitions).

    Input columns of these five names are replaced. Sources are in code-point order with null last; sizes count words, and null
    and empty texts have none. A source's whole repetitions hold for all its documents; the rest of its target is filled in
    a seeded random order, and documents without words are never in that rest. So a source's taken words miss its target by half
    a document at most. A source without words has target 0. Repeated rows are separate documents; rows equal in id, source and
    size may change places. An empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "repetitions", "taken"]
    mixed = _mix(docs, weights, share, cap, seed)
    own = [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added]
    return mixed.select(*own, *added)


def repeat_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each input row as often as it is taken, with the input's columns, whatever their names.

    Null and empty texts have no words, so they come in the whole repetitions only; texts are counted whole, however long; repeated rows are
    separate documents, and rows that tie in the random order are told apart by id and size; an empty table gives an empty table.
    """
    mixed = _mix(docs, weights, share, cap, seed).where("repetitions > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int"))))
    return copies.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
