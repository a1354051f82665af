"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A word's features are its n-grams of bytes with word marks, and the word itself, hashed into buckets. A text's vector is the
mean of its features' embeddings. The model is trained by stochastic gradient descent in numpy on a bounded
sample of words; a part of the sample is kept back to fit the temperature and the rejection. As mean and
softmax layer are linear, tasks only add up one small vector per word.

A softmax over the known languages is sure of itself on unknown ones, too. So a text is rejected by how familiar its features are: the
mean logarithm of their share of the predicted language's sample. What is too unfamiliar is learnt from texts that should be rejected: each
language in turn as if it hadn't been learnt, and words with their letters drawn at random.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, pieces

#: Documents per language that the model is fitted on, in the order of a hash of the id, words drawn from each, and documents in all.
FIT_DOCS, FIT_WORDS, FIT_TOTAL = 1_500, 64, 60_000
#: Languages that are learnt, the most frequent ones.
FIT_LANGUAGES = 400
BUCKETS, DIM, EPOCHS, RATE, BATCH = 1 << 16, 16, 4, 2.0, 64
KEPT_BACK = 0.2
#: Share of the kept-back texts that the rejection may lose, and of those to be rejected that it may let through.
LOST, LET_THROUGH = 0.002, 0.01
#: Words of the pieces that stand for short texts.
PIECE_WORDS = (2, 4, 8, 16, 32)
#: Parts in which each language's documents are ranked first.
SALTS = 64
CACHED_WORDS = 300_000
LONGEST_CACHED = 40
#: Bytes of what a scorer keeps of words.
CACHED_BYTES = 48 << 20
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    words = _LETTERS.findall(text.lower())
    # Beyond ASCII the pattern lets through runs of numerals such as a superscript two.
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of 1 to 4 bytes of ``<word>`` in UTF-8 and of the whole of it."""
    marked = f"<{word}>".encode()
    grams = [marked]
    for n in (1, 2, 3, 4):
        grams += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [h & (BUCKETS - 1) for h in map(zlib.crc32, grams)]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # of each bucket, what it adds to the languages' logits
    familiar: np.ndarray  # of each bucket, the logarithm of its share of the languages' samples
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = -np.inf
    short: float = 0.0

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        logits = (mean + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def rejects(self, familiarity: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Short texts vary more, so they may be less familiar."""
        return familiarity < self.threshold - self.short / np.sqrt(features)


@dataclass
class Scorer:
    """Adds up the words of a text, with a bounded cache of what each word adds."""

    model: LanguageModel
    row: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        width = 2 * len(self.model.languages) + 1
        self.both = np.hstack([self.model.table, self.model.familiar])
        self.sums = np.zeros((max(1, min(CACHED_WORDS, CACHED_BYTES // (8 * width))), width))

    def vectors(self, words: list[str]) -> np.ndarray:
        """What each word adds to the logits and to the familiarities, and its number of features."""
        bags = list(map(subwords, words))
        lengths = np.fromiter(map(len, bags), np.int64, len(bags))
        flat = np.fromiter(chain.from_iterable(bags), np.int64, lengths.sum())
        sums = np.add.reduceat(self.both[flat], np.append(0, lengths.cumsum()[:-1]), axis=0)
        return np.column_stack([sums, lengths])

    def text_sums(self, text: str) -> np.ndarray | None:
        words = letter_words(text)
        if not words:
            return None
        if len(self.row) >= len(self.sums):
            self.row.clear()
        rows = list(map(self.row.get, words))
        known = [k for k in rows if k is not None]
        total = self.sums[known].sum(axis=0)
        if len(known) < len(words):
            missing = Counter(w for w, k in zip(words, rows, strict=True) if k is None)
            vectors = self.vectors(list(missing))
            total = total + np.fromiter(missing.values(), np.float64, len(missing)) @ vectors
            for word, vector in zip(missing, vectors, strict=True):
                if len(word) <= LONGEST_CACHED and len(self.row) < len(self.sums):
                    self.sums[len(self.row)] = vector
                    self.row[word] = len(self.row)
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected. Of equal probabilities the first language in alphabetical order."""
        sums = self.text_sums(text) if text else None
        n = len(self.model.languages)
        if sums is None or not n:
            return UNDETERMINED, 0.0, True
        p = self.model.probabilities(sums[:n] / sums[-1])
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(self.model.rejects(sums[n + best] / sums[-1], sums[-1]))


class Bags:
    """The features of many pieces in one flat array of 16-bit buckets."""

    def __init__(self, pieces: list[list[str]]):
        known: dict[str, bytes] = {}

        def of(word: str) -> bytes:
            found = known.get(word)
            if found is None:
                found = known[word] = np.array(subwords(word), np.uint16).tobytes()
            return found

        each = [b"".join(map(of, piece)) for piece in pieces]
        self.lengths = np.array([len(b) // 2 for b in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(each), np.uint16)

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some pieces, one after the other, and their numbers."""
        lengths = self.lengths[chosen]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[chosen] - (ends - lengths), lengths)
        return self.flat[at], lengths

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean rows of ``table`` of all pieces, block by block."""
        out = np.empty((len(self.lengths), table.shape[1]))
        for a in range(0, len(out), 4096):
            at, lengths = self.take(np.arange(a, min(len(out), a + 4096)))
            out[a : a + 4096] = np.add.reduceat(table[at], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        return out


def fit_model(words: list[list[str]], langs: list[str], seed: int = 7) -> LanguageModel:
    """From the sampled words of each document and its language."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(languages)}
    held = rng.random(len(words)) < KEPT_BACK
    train, train_truth, back, back_truth = [], [], [], []
    for own, lang, kept in zip(words, langs, held, strict=True):
        # Short and long pieces of each document, so that short texts are learnt and calibrated too.
        k = 0
        while k < len(own):
            size = int(rng.choice(PIECE_WORDS))
            (back if kept else train).append(own[k : k + size])
            (back_truth if kept else train_truth).append(index[lang])
            k += size
    bags, truths = Bags(train), np.array(train_truth, np.int64)
    embeddings = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    steps = max(1, EPOCHS * -(-len(train) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for a in range(0, len(train), BATCH):
            chosen = order[a : a + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            at, lengths = bags.take(chosen)
            truth = truths[chosen]
            mean = np.add.reduceat(embeddings[at], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(truth)), truth] -= 1
            back_mean = p @ weights.T / lengths[:, None]
            order_at = at.argsort(kind="stable")
            sorted_at = at[order_at]
            first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
            grads = np.add.reduceat(np.repeat(back_mean, lengths, axis=0)[order_at], first, axis=0)
            embeddings[sorted_at[first]] -= rate * grads
            weights -= rate / len(truth) * mean.T @ p
            bias -= rate / len(truth) * p.sum(axis=0)
    counts = np.zeros((BUCKETS, len(languages)))
    for k in range(len(languages)):
        own = np.flatnonzero(truths == k)
        if len(own):
            counts[:, k] = np.bincount(bags.take(own)[0], minlength=BUCKETS)
    familiar = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    model = LanguageModel(languages, embeddings @ weights, familiar, bias)
    if back:
        calibrate(model, Bags(back), np.array(back_truth))
        whole = [(own, index[lang]) for own, lang, kept in zip(words, langs, held, strict=True) if kept and own]
        calibrate_rejection(model, [w for w, _ in whole], np.array([t for _, t in whole]), rng)
    return model


def calibrate(model: LanguageModel, bags: Bags, truth: np.ndarray) -> None:
    """The temperature with the least log loss."""
    means, rows = bags.means(model.table), np.arange(len(truth))
    best, chosen = np.inf, 1.0
    for temperature in np.geomspace(0.1, 10, 41):
        model.temperature = float(temperature)
        loss = -np.log(model.probabilities(means)[rows, truth] + 1e-12).mean()
        if loss < best:
            best, chosen = loss, float(temperature)
    model.temperature = chosen


def calibrate_rejection(model: LanguageModel, texts: list[list[str]], truth: np.ndarray, rng: np.random.Generator) -> None:
    """The least familiarity that is kept, from kept-back texts: their own, and what it is where they should be rejected.

    It lies halfway between the least familiar of the first and the most familiar of the second, or, where these overlap, so low that few
    of the first are lost. ``short`` is the most that it must give way for pieces of few words, times the root of their features.
    """
    bags = Bags(texts)
    familiarity = bags.means(model.familiar)
    own = familiarity[np.arange(len(truth)), truth]
    letters = np.array(sorted({c for words in texts for w in words for c in w}))
    drawn = Bags([["".join(rng.choice(letters, len(w))) for w in words] for words in texts])
    foreign = [drawn.means(model.familiar).max(axis=1)]
    if len(model.languages) > 1:
        # Each text as if its language hadn't been learnt: the most familiar of the others.
        others = familiarity.copy()
        others[np.arange(len(truth)), truth] = -np.inf
        foreign.append(others.max(axis=1))
    least, most = float(np.quantile(own, LOST)), max(float(np.quantile(f, 1 - LET_THROUGH)) for f in foreign)
    model.threshold = min(least, (least + most) / 2)
    model.short = 0.0
    for size in PIECE_WORDS:
        pieces_of = Bags([words[:size] for words in texts])
        found = pieces_of.means(model.familiar)[np.arange(len(truth)), truth]
        below = (model.threshold - found) * np.sqrt(pieces_of.lengths)
        model.short = max(model.short, float(np.quantile(below, 1 - LOST)))


def fit_languages(docs: DataFrame, train: Column, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> LanguageModel:
    """From the documents for which ``train`` holds and whose lang is not null; the driver gets drawn words only.

    The ``FIT_LANGUAGES`` most frequent languages are learnt, from ``fit_docs`` documents each, or fewer where there are many languages.
    """
    # First within parts of a language, so that a language with most of the rows isn't ranked in one task.
    salt = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(SALTS))
    order = [F.xxhash64("id"), F.col("id")]
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_LANGUAGES)
    languages = [r.lang for r in counted.collect()]
    fit_docs = max(1, min(fit_docs, FIT_TOTAL // max(1, len(languages))))
    narrow = labelled.where(F.col("lang").isin(languages))
    chosen = (
        narrow.select(F.col("doc_id").cast("long").alias("id"), "lang")
        .withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
        .where(F.col("rank") <= fit_docs)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("rank") <= fit_docs)
        .select("id", "lang")
        .distinct()
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            drawn = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = letter_words(text)
                rng = np.random.default_rng(abs(doc_id))
                # From the whole text, in order.
                some = np.sort(rng.choice(len(own), min(fit_words, len(own)), replace=False)) if own else []
                drawn.append(" ".join(_stretch(own[i], rng) for i in some))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.string())], names=["id", "lang", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("t"))
    # At most FIT_TOTAL narrow rows are broadcast.
    rows = texts.join(F.broadcast(chosen), ["id", "lang"]).select("id", "lang", "t")
    found = rows.mapInArrow(draw, "id long, lang string, words string").where("words <> ''").limit(fit_docs * max(1, len(languages))).collect()
    found.sort(key=lambda r: (r.id, r.lang, r.words))
    return fit_model([r.words.split(" ") for r in found], [r.lang for r in found])


def _stretch(word: str, rng: np.random.Generator) -> str:
    """The word, or of a long one, as of scripts without spaces, a stretch from anywhere in it."""
    if len(word) <= LONGEST_CACHED:
        return word
    at = int(rng.integers(len(word) - LONGEST_CACHED + 1))
    return word[at : at + LONGEST_CACHED]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Columns doc_id, lang_pred, score, rejected: one row per input row, by its whole text only.

    Texts that are null or have no letter are ``und`` with score 0 and rejected, as are all if nothing was learnt. Repeated rows
    are told alike; texts are read whole, however long; other columns are ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in pieces(batches):
            scorer = scorer or Scorer(shared.value)
            found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with all columns and in their order.

    Null and empty texts and texts without a letter go, as does every text if nothing was learnt; texts are read whole, however long; repeated
    rows and rows of equal texts stay or go together; columns of any names are kept as they are; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge_of_task():
        scorer = Scorer(shared.value)
        return lambda texts: [not scorer.predict(t)[2] for t in texts]

    return keep_rows(docs, judge_of_task)
