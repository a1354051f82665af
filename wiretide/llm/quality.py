"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver in numpy from a bounded sample of labelled rows (statistics only, no texts), flattened into
arrays, and sent to the tasks, which score whole texts batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, pieces

#: Labelled rows that the trees are fitted on, taken in the order of a hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 2.0
ACCEPT = 0.7

# Byte groups whose shares are statistics.
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line_feed": b"\n",
    "stop": b".",
    "comma": b",;:",
    "excited": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>\\/_`",
    "bracket": b"()[]{}",
    "quote": b"\"'",
    "hyphen": b"-",
    "other": bytes(range(128, 256)),
}
N_STATS = len(_GROUPS) + 13


def group_matrix() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS)))
    for k, members in enumerate(_GROUPS.values()):
        out[list(members), k] = 1
    return out


def statistics(text: bytes, groups: np.ndarray) -> list[float]:
    """Statistics of one whole text in UTF-8; all are 0 for an empty one."""
    words, lines = text.split(), text.split(b"\n")
    n, n_words, n_lines = len(text), len(words), len(lines)
    if not n_words:
        return [0.0] * N_STATS
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ groups / n
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words))
    capital = sum(map(bytes.isupper, words))
    titled = sum(map(bytes.istitle, words))
    alpha = sum(map(bytes.isalpha, words))
    line_lengths = np.fromiter(map(len, lines), np.int64, n_lines)
    return [
        *shares.tolist(),
        float(np.log1p(n)),
        float(np.log1p(n_words)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        distinct / n_words,
        distinct / n_words**0.5,
        repeats / n_words,
        capital / n_words,
        titled / n_words,
        alpha / n_words,
        len(set(lines)) / n_lines,
        float(line_lengths.mean()),
    ]


@dataclass
class Trees:
    """Full binary trees of one depth: node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        total = np.full(len(stats), self.start)
        rows = np.arange(len(stats))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(stats), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (stats[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(stats: np.ndarray, labels: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; splits are chosen from histograms of quantile bins."""
    n, width = stats.shape if len(stats) else (0, N_STATS)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    # One row of each label is added to the counts, so that the start is finite.
    share = (labels.sum() + 1) / (n + 2)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not n or labels.min() == labels.max():
        return model
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, stats[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    total = np.full(n, model.start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - labels, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (count, width, BINS)
            g = np.bincount(at, np.repeat(grad, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (stats[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        value = -RATE * g / (h + SHRINK)
        total += value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(model.start, np.array(features), np.array(thresholds), np.array(values))


def _stats_rows(rows: DataFrame, label: bool) -> DataFrame:
    """``id``, the statistics of ``t`` as one binary value, and ``label`` where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = group_matrix()
        for batch in pieces(batches):
            stats = [np.array(statistics(t, groups)).tobytes() for t in batch.column(1).to_pylist()]
            more = [batch.column(2)] if label else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.binary()), *more], names=["id", "stats", "label"][: 2 + label])

    return rows.mapInArrow(run, "id long, stats binary" + ", label int" * label)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from the rows of ``labels`` (doc_id, quality) for which ``train`` holds; null labels and ids are left out.

    An id labelled more than once counts as 1 if one of its labels is. Without rows, or with one label only, the score
    is that label's smoothed share.
    """
    order = [F.xxhash64("id"), F.col("id")]
    chosen = (
        labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(*order)
        .limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    # At most fit_rows narrow rows are broadcast.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "t", "label")
    found = _stats_rows(rows, label=True).orderBy(*order, "stats").limit(fit_rows).collect()
    stats = np.array([np.frombuffer(r.stats) for r in found]) if found else np.zeros((0, N_STATS))
    return fit_trees(stats, np.array([r.label for r in found], np.float64))


def score_quality(docs: DataFrame, model: Trees, accept: float = ACCEPT) -> DataFrame:
    """Columns doc_id, score, predicted: one row per input row, by its whole text only.

    Null and empty texts have statistics of 0 and the score of those; repeated rows are scored alike; other columns are
    ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = group_matrix()
        for batch in pieces(batches):
            if batch.num_rows:
                stats = np.array([statistics(t, groups) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(stats))], names=["id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias("doc_id"), "score", (F.col("score") >= accept).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Trees, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all columns, whatever their names.

    Null and empty texts are judged by statistics of 0; texts are judged whole, however long; repeated rows and rows of equal texts stay or go
    together; a score equal to ``accept`` stays; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge_of_task():
        groups = group_matrix()

        def judge(texts: list) -> list[bool]:
            stats = [statistics((t or "").encode(), groups) for t in texts]
            return (shared.value.score(np.array(stats).reshape(-1, N_STATS)) >= accept).tolist()

        return judge

    return keep_rows(docs, judge_of_task)
