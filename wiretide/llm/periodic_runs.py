"""Periodic runs: maximal stretches of words that repeat with one period, and texts with the repeats left out.

A run is a stretch with smallest period q, at least ``PERIODS`` periods and ``WORDS`` words long, that no neighbouring word extends. Every
run has a Lyndon root: a place where the longest Lyndon word, by the order of words or by its reverse, has the length of the period. So
each place and order is a candidate, extended both ways by the longest common extension of two suffixes (suffix tree of the
text) and of two prefixes (suffix tree of its reversal).

In a run each word stands at least ``PERIODS`` times. So texts are first cut at words that come less often in their piece, again and
again, until nothing changes; trees are built of pieces of ``WORDS`` words or more. No run reaches beyond a piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, words_of
from .suffix_tree import SuffixTree

WORDS = 24
PERIODS = 3


def find_runs(words: list, least: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period. ``periods`` is 2 or more."""
    n = len(words)
    if n < least:
        return []
    counts = Counter(words)
    often = np.fromiter(map(counts.__getitem__, words), np.int64, n) >= periods
    found = []
    for a, b in stretches(often, least):
        numbers: dict = {}
        symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words[a:b]], np.int64)
        for low, high in repeating_pieces(symbols, least, periods):
            _, piece = np.unique(symbols[low:high], return_inverse=True)
            found += [(a + low + s, size, p) for s, size, p in runs_of_piece((piece + 1).tolist(), least, periods)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(wanted: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal stretches of true values that are long enough, as (from, to)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]]).astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def repeating_pieces(symbols: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """The pieces in which every symbol comes ``periods`` times or more, as (from, to)."""
    done, open_pieces = [], [(0, len(symbols))]
    while open_pieces:
        a, b = open_pieces.pop()
        _, inverse, counts = np.unique(symbols[a:b], return_inverse=True, return_counts=True)
        often = counts[inverse] >= periods
        if often.all():
            done.append((a, b))
        else:
            open_pieces += [(a + low, a + high) for low, high in stretches(often, least)]
    return done


def lyndon_lengths(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word at each place, by the order and by its reverse (0: none ends before the text does).

    It ends where the next smaller suffix starts; by the reversed order, the next greater one.
    """
    n = len(ranks)
    smaller, greater = [0] * n, [0] * n
    falling, rising = [], []
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while falling and ranks[falling[-1]] > r:
            falling.pop()
        smaller[i] = (falling[-1] if falling else n) - i
        falling.append(i)
        while rising and ranks[rising[-1]] < r:
            rising.pop()
        greater[i] = rising[-1] - i if rising else 0
        rising.append(i)
    return np.array(smaller), np.array(greater)


def runs_of_piece(symbols: list[int], least: int, periods: int) -> list[tuple[int, int, int]]:
    n = len(symbols)
    forward = SuffixTree(symbols)
    places = np.arange(n)
    smaller, greater = lyndon_lengths(forward.ranks().tolist())
    at, period = np.concatenate([places, places]), np.concatenate([smaller, greater])
    fits = (period > 0) & (period * periods <= n)
    at, period = at[fits], period[fits]
    if not len(at):
        return []
    after = forward.common(at, at + period)
    del forward
    backward = SuffixTree(symbols[::-1])
    before = backward.common(n - at, n - at - period)
    start = at - before
    length = before + period + after
    enough = length >= np.maximum(least, periods * period)
    runs = np.unique(np.stack([start, length, period], axis=1)[enough], axis=0)
    return [tuple(run) for run in runs.tolist()]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside of all runs, and the first period of each run where no other run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, least: int = WORDS, periods: int = PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, runs (array of start, length, period; by start, then period), collapsed (text).

    Words are the runs of other characters than white space. ``collapsed`` is the kept words joined by one space: a word goes if a run
    holds it after that run's first period. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Texts are
    searched whole, however long, in memory linear in their words; repeated rows give a row each; equal exponents are no matter
    here, as all runs are given; other columns are ignored; an empty table gives an empty table.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["start", "length", "period"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                # Splitting bytes knows exactly this white space.
                words = text.encode().split()
                found = find_runs(words, least, periods)
                counts.append(len(words))
                runs.append([dict(zip(names, run, strict=True)) for run in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(search, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, exactly; of equals the one with the smallest start, then period. Null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")

    def better(best: Column, run: Column) -> Column:
        more, old = run["length"] * best["period"], best["length"] * run["period"]
        first = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (more > old) | ((more == old) & first), run).otherwise(best)

    return F.aggregate(runs, none, better)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the rows of ``periodic_runs``: n_runs, the strongest run's start, length, period and exponent_milli, and two hashes.

    ``runs_sha256`` is of the lines ``start,length,period``, ``collapsed_sha256`` of the collapsed text. Without runs the four are null.
    """
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts repeat a stretch up to their end: with h the crc32 of the id as text and g = h / 10,
    texts with h % 10 = 0 have the words from a = g % n on replaced by repeats of the first 1 + (n - a) / (3 + g % 8) of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    sized = chosen.select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").cast("long").alias("n"))
    sized = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), 1, (F.col("n") - F.col("a")).cast("int"))
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
