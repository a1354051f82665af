"""The greedy recurrence behind cooldowns and anchored windows.

Per key and in time order: take the first time that is at least ``gap`` after
the last one taken. Taken one after the other this is sequential, and one key
may hold most of the rows, so long histories are reduced level by level:

* An item ``(u, x)`` says "entered at time u, the next time may be taken from x
  on". On the lowest level ``x = u + gap``.
* ``lift`` cuts a key's history into spans. All that the rest of the history
  needs from a span is, for each time at which the chain can enter it, where
  the chain leaves it. The chain always enters a span within ``gap`` of its
  start, or at the first item after that. So a level shrinks by about the ratio
  of span to gap, and entries with the same exit collapse into one.
* Once a key is short, one pass over its items picks the true entries, and
  ``expand`` walks each span from its known entry, all spans in parallel.

A forced item is taken whatever came before it.

A long key with few gaps in its history needs none of that: each step of its
chain is the minimum of the times from where it opens, a combining aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import slice_start
from ..scratch import materialize

# Items of one key that a single pass handles; steps that are taken one by one; items of a span; gaps per span on each level.
FOLD_ROWS = 50_000
FEW_STEPS = 48
SPAN_ROWS = 16_000_000
SPAN_GAPS = 16

_NEVER = -(2**62)


def _next_items(u: np.ndarray, x: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """Position of the item taken after each item; ``len(u)`` when the span is left."""
    n = len(u)
    following = np.searchsorted(u, x, side="left")
    if forced.any():
        next_forced = np.full(n + 1, n)
        next_forced[:n][forced] = np.flatnonzero(forced)
        next_forced = np.minimum.accumulate(next_forced[::-1])[::-1]
        following = np.minimum(following, next_forced[1:])
    return following


def _arrays(table: pa.Table, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``u``, ``x`` and ``forced`` in the order of ``u``. The lowest level leaves out what follows from ``u``."""
    u, names = table["u"].to_numpy(), table.column_names
    order = np.argsort(u, kind="stable")
    u = u[order]
    x = table["x"].to_numpy()[order] if "x" in names else u + gap
    if "forced" not in names:
        return u, x, np.zeros(len(u), dtype=bool)
    return u, x, table["forced"].to_numpy(zero_copy_only=False).astype(bool)[order]


def _first_forced(forced: np.ndarray) -> int:
    return int(np.argmax(forced)) if forced.any() else len(forced)


def _result(table: pa.Table, key: list[str], columns: dict[str, np.ndarray]) -> pa.Table:
    """``columns`` with the key of the group in front."""
    n = len(columns["u"])
    keys = {k: pa.repeat(table[k][0], n) if n else table[k].slice(0, 0) for k in key}
    return pa.table({**keys, **{name: pa.array(values) for name, values in columns.items()}})


def _lift_span(table: pa.Table, key: list[str], gap: int) -> pa.Table:
    u, x, forced = _arrays(table, gap)
    n = len(u)
    jump = np.append(_next_items(u, x, forced), n)
    last = np.arange(n + 1)
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    leave = x[last[:n]]
    must = _first_forced(forced)
    # A time still closed by an earlier span opens less than a gap into this one,
    # and nothing gets past the first forced item.
    reachable = int(np.searchsorted(u, table["span"][0].as_py() + gap, side="left")) + 1
    entries = min(reachable, must, n)
    keep = np.zeros(n, dtype=bool)
    if entries:
        keep[:entries] = np.append(leave[1:entries] != leave[: entries - 1], True)
    if must < n:
        keep[must] = True
    return _result(table, key, {"u": u[keep], "x": leave[keep], "forced": forced[keep]})


def _expand_span(items: pa.Table, entries: pa.Table, key: list[str], gap: int) -> pa.Table:
    """The chain through one span. A later entry, at a forced item, lies on the same chain."""
    u, x, forced = _arrays(items, gap)
    taken, opened = [], []
    if len(u) and len(entries):
        opens = entries["opens"][int(np.argmin(entries["u"].to_numpy()))].as_py()
        taken, opened, _ = chain(u, x, np.flatnonzero(forced), opens)
    return _result(items, key, {"u": u[taken], "opens": np.array(opened, dtype="int64")})


def chain(u: np.ndarray, x: np.ndarray, must: np.ndarray, opens: int) -> tuple[list[int], list[int], int]:
    """Positions taken, when each was open, and the time from which the next may be taken. ``must``: forced positions."""
    taken, opened, at = [], [], 0
    while True:
        due = at + int(np.searchsorted(u[at:], opens, side="left"))
        later = int(np.searchsorted(must, at, side="left"))
        if later < len(must):
            due = min(due, int(must[later]))
        if due >= len(u):
            return taken, opened, opens
        taken.append(due)
        opened.append(opens)
        opens, at = int(x[due]), due + 1


def _walk(
    batches: Iterator[pa.RecordBatch], key: list[str], arrays: Callable[[pa.RecordBatch], tuple]
) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
    """The chain over batches sorted by key and time: each batch, the positions taken, and when they were open.

    ``arrays`` gives a batch's times, next times and forced flags. Only the state of the last key is held.
    """
    last, opens = None, _NEVER
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        u, x, forced = arrays(batch)
        new = np.zeros(n, dtype=bool)
        for k in key:
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        must = np.flatnonzero(forced)
        taken, opened = [], []
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            own = [batch.column(k)[a].as_py() for k in key]
            if own != last:
                last, opens = own, _NEVER
            inside = must[np.searchsorted(must, a) : np.searchsorted(must, b)] - a
            at, since, opens = chain(u[a:b], x[a:b], inside, opens)
            taken += [a + i for i in at]
            opened += since
        yield batch, taken, opened


def _dealt(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Whole keys in one partition each, sorted; without a key, all rows in one."""
    dealt = rows.repartition(*key) if key else rows.repartition(1)
    return dealt.sortWithinPartitions(*key, *order)


def _fold(items: DataFrame, key: list[str]) -> DataFrame:
    """The chain over short keys: rows ``key, u, opens`` where ``opens`` is the earliest time allowed there."""

    def arrays(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "x", "forced"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, taken, opened in _walk(batches, key, arrays):
            out = batch.select([*key, "u"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(opened, pa.int64())], names=[*key, "u", "opens"])

    schema = _key_schema(items, key, u=T.LongType(), opens=T.LongType())
    return _dealt(items.select(*key, "u", "x", "forced"), key, "u", "x").mapInArrow(run, schema)


def _in_spans(items: DataFrame, length: int) -> DataFrame:
    return items.withColumn("span", slice_start(F.col("u"), length))


def _key_schema(items: DataFrame, key: list[str], **columns: T.DataType) -> T.StructType:
    return T.StructType([items.schema[k] for k in key] + [T.StructField(n, t) for n, t in columns.items()])


def _lift(items: DataFrame, key: list[str], gap: int, length: int) -> DataFrame:
    schema = _key_schema(items, key, u=T.LongType(), x=T.LongType(), forced=T.BooleanType())
    spans = _in_spans(items, length).groupBy(*key, "span")
    return spans.applyInArrow(lambda table: _lift_span(table, key, gap), schema)


def _expand(items: DataFrame, entries: DataFrame, key: list[str], gap: int, length: int) -> DataFrame:
    schema = _key_schema(items, key, u=T.LongType(), opens=T.LongType())
    spans = _in_spans(items, length).groupBy(*key, "span").cogroup(_in_spans(entries, length).groupBy(*key, "span"))
    return spans.applyInArrow(lambda left, right: _expand_span(left, right, key, gap), schema)


def span_gaps_for(rows_per_gap: int, span_gaps: int = SPAN_GAPS) -> int:
    """Gaps per span, fewer where the traffic is dense, so that a span stays near ``SPAN_ROWS``."""
    return max(2, min(span_gaps, SPAN_ROWS // max(rows_per_gap, 1)))


def _sizes(items: DataFrame, key: list[str], length: int) -> tuple[int, int, int]:
    """The most items of one key, the most items of one span and the most spans of one key."""
    per_span = items.groupBy(*key, slice_start(F.col("u"), length).alias("span")).count()
    per_key = per_span.groupBy(*key).agg(
        F.sum("count").alias("n"), F.max("count").alias("densest"), F.count(F.lit(1)).alias("spans")
    )
    row = per_key.agg(F.max("n"), F.max("densest"), F.max("spans")).first()
    return tuple(value or 0 for value in row)


def fold_times(times: DataFrame, key: list[str], gap_us: int) -> DataFrame:
    """``greedy_times`` in one pass, for keys of a checked size."""
    forced = F.col("forced") if "forced" in times.columns else F.lit(False)
    return _fold(times.select(*key, "u", (F.col("u") + F.lit(gap_us)).alias("x"), forced.alias("forced")), key)


def greedy_times(
    times: DataFrame,
    key: list[str],
    gap_us: int,
    lift_first: bool = False,
    fold_rows: int = FOLD_ROWS,
    span_gaps: int = SPAN_GAPS,
) -> DataFrame:
    """Times taken by the greedy chain of each key, as rows ``key, u, opens``.

    ``times`` has the key columns, ``u BIGINT`` and, if any time is forced,
    ``forced BOOLEAN``. A row with ``u < opens`` was taken only because it is
    forced. ``lift_first`` skips sizing the lowest level, for input that is
    known to be large and is better not written out.
    """
    items = times
    levels: list[tuple[DataFrame, int]] = []
    length = gap_us
    while True:
        if levels or not lift_first:
            longest, densest, spans = _sizes(items, key, length)
            if longest <= fold_rows:
                break
            if levels and spans <= 1:
                # One span per key: nothing comes before it, so only its first item is entered.
                first = F.min(F.struct("u", "x", "forced")).alias("_first")
                items = items.groupBy(*key).agg(first).select(*key, "_first.*")
                break
            length *= span_gaps_for(densest, span_gaps)
        else:
            length *= span_gaps
        levels.append((items, length))
        items = materialize(_lift(items, key, gap_us, length))
    chosen = _fold(items, key) if levels else fold_times(items, key, gap_us)
    for below, span in reversed(levels):
        chosen = _expand(below, chosen, key, gap_us, span)
    return chosen


def cooldown(
    df: DataFrame,
    key: str | list[str],
    cooldown_us: int,
    forced: str | None = None,
    fold_rows: int = FOLD_ROWS,
    span_gaps: int = SPAN_GAPS,
    longest: int | None = None,
) -> DataFrame:
    """Rows of ``df`` that fire: at least the cooldown after the key's last fired row, or forced.

    Rows are taken in the order ``ts_us, seq``. The boundary is inclusive. ``longest`` is a bound of any key's rows, where one is known; with
    none, or a large one, ``df`` is written out, because its keys have to be sized before they are folded.
    """
    if cooldown_us == 0:
        return df
    key = [key] if isinstance(key, str) else list(key)
    must = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    if longest is not None and longest <= fold_rows:
        return _fold_rows(df, key, cooldown_us, must)
    rows = materialize(df)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    if rows.count() <= fold_rows or (sizes.agg(F.max("_n")).first()[0] or 0) <= fold_rows:
        return _fold_rows(rows, key, cooldown_us, must)
    long_keys = materialize(sizes.filter(F.col("_n") > fold_rows).select(*key))
    short = _fold_rows(rows.join(long_keys, key, "left_anti"), key, cooldown_us, must)
    hot = rows.join(long_keys, key, "left_semi")
    return short.unionByName(_chain_rows(hot, key, cooldown_us, must, fold_rows, span_gaps).select(*rows.columns))


def _fold_rows(rows: DataFrame, key: list[str], gap: int, must: Column) -> DataFrame:
    """The cooldown as one pass over sorted rows, for keys of a checked size."""

    def arrays(batch: pa.RecordBatch) -> tuple:
        u = batch.column("ts_us").to_numpy(zero_copy_only=False)
        return u, u + gap, batch.column("_must").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, taken, _ in _walk(batches, key, arrays):
            yield batch.drop_columns(["_must"]).take(pa.array(taken, pa.int64()))

    return _dealt(rows.withColumn("_must", must), key, "ts_us", "seq").mapInArrow(run, rows.schema)


def _few_steps(times: DataFrame, key: list[str], gap: int, steps: int) -> DataFrame:
    """The chain of each key without forced times, one step after the other: rows ``key, u, opens``."""
    taken = []
    now = materialize(times.groupBy(*key).agg(F.min("u").alias("u")))
    for _ in range(steps):
        taken.append(now.withColumn("opens", F.lit(_NEVER)))
        opens = now.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], (F.col("u") + F.lit(gap)).alias("_opens"))
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)]
        later = times.join(opens, reduce(Column.__and__, same) & (F.col("u") >= F.col("_opens")))
        now = materialize(later.groupBy(*key).agg(F.min("u").alias("u")))
    return reduce(DataFrame.unionByName, taken)


def _chain_rows(rows: DataFrame, key: list[str], gap: int, must: Column, fold_rows: int, span_gaps: int) -> DataFrame:
    """The cooldown for long keys: a chain over their distinct times, then back to the rows.

    At one time, the first row fires if the time is due; forced rows always fire.
    """
    any_forced = F.max(must).alias("forced")
    times = materialize(rows.groupBy(*key, F.col("ts_us").alias("u")).agg(any_forced, F.min("seq").alias("seq")))
    extent = times.groupBy(*key).agg((F.max("u") - F.min("u")).alias("_extent"), F.max("forced").alias("_forced"))
    longest, any_forced = extent.agg(F.max("_extent"), F.max("_forced")).first()
    steps = (longest or 0) // gap + 1
    if steps <= FEW_STEPS and not any_forced:
        taken = _few_steps(times.select(*key, "u"), key, gap, steps)
    else:
        found = greedy_times(times.select(*key, "u", "forced"), key, gap, fold_rows=fold_rows, span_gaps=span_gaps)
        taken = materialize(found)
    due = taken.filter(F.col("u") >= F.col("opens")).select(*key, "u")
    heads = materialize(times.join(due, [*key, "u"], "left_semi").select(*key, F.col("u").alias("ts_us"), "seq"))
    # Repeated rows share the head's time and seq; one of them fires, as in the pass over sorted rows.
    at_head = rows.filter(~must).join(heads, [*key, "ts_us", "seq"], "left_semi").dropDuplicates([*key, "ts_us", "seq"])
    return rows.filter(must).unionByName(at_head)
