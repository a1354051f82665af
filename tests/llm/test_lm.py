from __future__ import annotations

import collections
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from wiretide.llm import lm_scoring
from wiretide.llm.common import id_remainder
from wiretide.llm.lm_scoring import END, STRENGTH, Chunk, ChunkBuilder, Model, far_ratio, lm_scores, merge_bucket, numbered, packed, ratios_of, sampled, seat, stirling_ratios, unpacked


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def check_counts(rows, found, train):
    counts = collections.Counter()
    for r in rows:
        if train(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (
            (r.doc_id, not train(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n) for r in rows
        ),
        key=repr,
    )
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found), key=repr) == expected
    base = sorted(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r.text)) for r in rows)
    assert sorted(r.base_score for r in found) == pytest.approx(base)


def in_training(doc_id):
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % 7 != 2


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 50])
def test_awkward_rows(spark, chunk_bytes):
    docs = awkward(spark)
    found = lm_scores(docs, id_remainder(F.col("doc_id"), 7) != 2, chunk_bytes=chunk_bytes)
    rows = found.collect()
    check_counts(docs.collect(), rows, in_training)
    assert all(r.score <= 1e-9 and r.perplexity >= 1 - 1e-9 for r in rows)
    assert len({round(r.score, 9) for r in rows if r.doc_id in (1, 2, 3)}) == 1


def test_empty_and_untrained(spark):
    docs = awkward(spark)
    assert lm_scores(docs.limit(0), F.lit(True)).count() == 0
    rows = lm_scores(docs, F.lit(None).cast("boolean")).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.held_out for r in rows)


def one_bucket(texts, train, n_contexts=None):
    """A corpus as one chunk and one bucket: the chunk, the bucket's row, and the model with its first totals."""
    builder = ChunkBuilder(0)
    for k, text in enumerate(texts):
        builder.add(k, text.encode(), train(k))
    row = builder.finish()
    own = np.array(row["top_hash"][:n_contexts], np.int64) if n_contexts else np.frombuffer(row["hashes"], np.int64)
    model = Model(np.unique(own), 1)
    chunk, n = Chunk(row, model), model.n_contexts
    merged = merge_bucket(list(chunk.requests(0, model)), n)
    sums = np.array(merged["sums"], float)
    model.tables, model.customers, model.tokens, model.words = sums[:n], sums[n : 2 * n], int(sums[2 * n]), int(sums[2 * n + 1])
    model.parent_customers, model.parent_tables = model.tables.sum(), float(model.words)
    return chunk, merged, model


def test_shares_sum_to_one():
    """In each sample, what is seated and what escapes add up to one in each restaurant."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(12)], range(12, 0, -1), k=15)) for _ in range(60)]
    # Held-out texts ask for every word after every word.
    texts += [" ".join(f"w{a} w{b}" for b in range(12)) for a in range(12)] + [f"w{a}" for a in range(12)] + ["w0 new", "new w0"]
    chunk, merged, model = one_bucket(texts, lambda k: k < 60 and k % 5 > 0, n_contexts=6)
    seating, last = sampled(merged, model, 5, 2)
    assert model.tokens == model.customers.sum() == 48 * 16 and last.parent_customers == last.tables.sum()
    chances = seating.chances(last)
    totals = np.bincount(seating.context, chances, model.n_contexts)
    asked = np.bincount(seating.context, minlength=model.n_contexts)
    # The twelve words, the end and one unknown word.
    full = asked == 14
    assert full.sum() >= 1 and totals[full] == pytest.approx(1, abs=1e-9)
    assert (totals < 1 + 1e-9).all() and (chances > 0).all()


class PlainRestaurants:
    """The same model with every customer at a table of its own record, taken out and seated again one at a time."""

    def __init__(self, pairs, words, discount, parent_discount, seed):
        self.rng, self.words, self.d, self.d0 = random.Random(seed), words, discount, parent_discount
        self.tables = collections.defaultdict(list)  # (context, word): customers of each table
        self.parent = collections.defaultdict(list)  # word: customers of each table of the parent
        self.t, self.c = collections.Counter(), collections.Counter()
        self.t0 = self.c0 = 0
        self.pairs = list(pairs)
        for context, word in self.pairs:
            self.sit(context, word)

    def below(self, word):
        seated = sum(self.parent[word]) - self.d0 * len(self.parent[word])
        return (seated + (STRENGTH + self.d0 * self.t0) / (self.words + 1)) / (STRENGTH + self.c0)

    def chance(self, context, word):
        at = self.tables[context, word]
        escape = (STRENGTH + self.d * self.t[context]) * self.below(word)
        return (sum(at) - self.d * len(at) + escape) / (STRENGTH + self.c[context])

    def choose(self, tables, discount, opening):
        x = self.rng.random() * (sum(tables) - discount * len(tables) + opening)
        for k, n in enumerate(tables):
            x -= n - discount
            if x < 0:
                return k
        return len(tables)

    def sit(self, context, word):
        at = self.tables[context, word]
        k = self.choose(at, self.d, (STRENGTH + self.d * self.t[context]) * self.below(word))
        self.c[context] += 1
        if k < len(at):
            at[k] += 1
            return
        at.append(1)
        self.t[context] += 1
        up = self.parent[word]
        k = self.choose(up, self.d0, (STRENGTH + self.d0 * self.t0) / (self.words + 1))
        self.c0 += 1
        if k < len(up):
            up[k] += 1
        else:
            up.append(1)
            self.t0 += 1

    def leave(self, context, word):
        at = self.tables[context, word]
        k = self.rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        self.c[context] -= 1
        if at[k]:
            return
        del at[k]
        self.t[context] -= 1
        up = self.parent[word]
        k = self.rng.choices(range(len(up)), up)[0]
        up[k] -= 1
        self.c0 -= 1
        if not up[k]:
            del up[k]
            self.t0 -= 1

    def sweep(self):
        for context, word in self.pairs:
            self.leave(context, word)
            self.sit(context, word)


def test_probabilities_against_a_plain_sampler():
    """Mean probabilities of all pairs of a small corpus, and its score, against the sampler that seats one customer at a time."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(9)], [40, 20, 10, 8, 6, 4, 2, 1, 1], k=12)) for _ in range(40)]
    chunk, merged, model = one_bucket(texts, lambda k: k % 7 != 2)
    model.discount, model.parent_discount = 0.6, 0.4
    seating, last = sampled(merged, model, 440, 40)
    found = seating.chances(last)
    train = np.repeat(chunk.train, chunk.lengths)
    pairs = [(int(chunk.pair_context[p]), int(chunk.pair_word[p])) for p in chunk.token_pair[train]]
    plain = PlainRestaurants(pairs, model.words, 0.6, 0.4, 1)
    mean, tables, kept = np.zeros(len(found)), 0, 300
    for number in range(kept + 40):
        plain.sweep()
        if number >= 40:
            mean += [plain.chance(int(c), int(w)) / kept for c, w in zip(chunk.pair_context, chunk.pair_word, strict=True)]
            tables += plain.c0 / kept
    sampled_tables = seating.kept["kept_totals"].reshape(-1, 2)[:, 0].mean()
    assert sampled_tables == pytest.approx(tables, rel=0.03)
    scores = [np.log10(x)[chunk.token_pair].sum() for x in (found, mean)]
    assert scores[0] == pytest.approx(scores[1], rel=0.002)
    assert found == pytest.approx(mean, rel=0.08)


def test_better_than_the_base_on_held_out_texts(spark):
    """Words that depend on the word before them."""
    rng = random.Random(2)
    follows = {f"a{k}": [f"a{(k * 7 + j) % 200}" for j in range(4)] for k in range(200)}

    def text():
        w, out = "a0", []
        for _ in range(60):
            w = rng.choice(follows[w])
            out.append(w)
        return " ".join(out)

    docs = documents(spark, [(k, text(), "en", "s") for k in range(400)])
    train = id_remainder(F.col("doc_id"), 7) != 2
    found = lm_scores(docs, train, chunk_bytes=20_000).collect()
    held = [r for r in found if r.held_out]
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    # Four followers each: log10(1/4) is the best there is.
    assert math.log10(1 / 4) - 0.15 < per_token < -0.55
    assert all(r.score > r.base_score for r in held)
    # Chunks change how the work is dealt out and which numbers are drawn, not the model.
    whole = {r.doc_id: r.score for r in lm_scores(docs, train).collect()}
    assert [r.score for r in found] == pytest.approx([whole[r.doc_id] for r in found], rel=0.02)


def mean_tables(customers, strength, per_table, discount):
    """Written out: the weights of all numbers of tables."""
    weights = [0.0, 1.0]
    for c in range(1, customers):
        stay = [(c - discount * t) * w for t, w in enumerate(weights)] + [0.0]
        weights = [a + b for a, b in zip(stay, [0.0, *weights], strict=True)]
        top = max(weights)
        weights = [w / top for w in weights]
    for t in range(2, customers + 1):
        weights[t] *= math.prod(strength + per_table * j for j in range(1, t))
    return sum(t * w for t, w in enumerate(weights)) / sum(weights)


@pytest.mark.parametrize(
    "law", [(60, 5.0, 0.0, 0.8), (60, 2.0, 0.6, 0.5), (60, 0.05, 0.0, 0.7), (40, 5.0, 0.1, 0.3), (3, 1.0, 0.2, 0.5), (1, 1.0, 0.2, 0.5)]
)
def test_seating_has_the_law_of_its_customers(monkeypatch, law):
    customers, strength, per_table, discount = law
    n, rng = 20_000, np.random.default_rng(2)
    draw = lambda: seat(np.full(n, customers), np.full(n, strength), np.full(n, per_table), discount, rng).mean()
    expected = mean_tables(*law)
    assert draw() == pytest.approx(expected, rel=0.01)
    # By the saddle point, as for dishes of many customers.
    monkeypatch.setattr(lm_scoring, "EXACT", 30)
    assert draw() == pytest.approx(expected, rel=0.05)


def test_weights_beyond_a_double():
    """So strong a restaurant that the weights can't be written down without logarithms."""
    n, rng = 4000, np.random.default_rng(3)
    drawn = seat(np.full(n, 200), np.full(n, 1e5), np.full(n, 0.0), 0.5, rng)
    # Nearly every customer opens a table: 200 less the pairs that join.
    log_weights = np.concatenate([[0], np.cumsum(np.log(ratios_of(stirling_ratios(0.5, 200), 200) * 1e5))])
    p = np.exp(log_weights - log_weights.max())
    assert drawn.mean() == pytest.approx((p * np.arange(1, 201)).sum() / p.sum(), rel=0.002) and log_weights.max() > 710


def test_ratios_of_many_customers():
    for discount, error in ((0.3, 0.05), (0.5, 0.002), (0.8, 0.01)):
        exact = ratios_of(stirling_ratios(discount, 900), 900)
        t = np.arange(1, 900)
        about = far_ratio(np.full(899, 900.0), t.astype(float), discount)
        assert (np.abs(about / exact - 1)[:800] < error).all()


def test_rare_words_are_contexts(spark):
    """Each of 3,000 words has one follower, and all of them are as rare; pairs come in any order."""
    rng = random.Random(4)
    drawn = [k for k in range(3000) for _ in range(7)]
    rng.shuffle(drawn)
    texts = [" ".join(f"k{k} v{k}" for k in drawn[a : a + 30]) for a in range(0, len(drawn), 30)]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    train = id_remainder(F.col("doc_id"), 7) != 2
    for chunk_bytes in (1 << 24, 60_000):
        held = [r for r in lm_scores(docs, train, chunk_bytes=chunk_bytes).collect() if r.held_out]
        per_pair = 2 * sum(r.score for r in held) / sum(r.n_tokens for r in held)
        # One word of a pair in 3,000, the other known from it but for a few tenths.
        assert per_pair > -math.log10(3000) - 0.6


def test_sweeps_see_all_buckets(spark, monkeypatch):
    """Texts of words seen once, and of ten words over and over: each sweep starts from totals over all buckets."""
    rng = random.Random(6)
    new = iter(range(10**9))
    common = lambda k: f"c{(k + rng.choice([1, 1, 1, 1, 2, 3, rng.randrange(10)])) % 10}"

    def text(k):
        if k % 2:
            return " ".join(f"n{next(new)}" for _ in range(60))
        out = [rng.randrange(10)]
        while len(out) < 60:
            out.append(int(common(out[-1])[1:]))
        return " ".join(f"c{c}" for c in out)

    docs = documents(spark, [(k, text(k), "en", "s") for k in range(600)])
    train = id_remainder(F.col("doc_id"), 7) != 2
    # The totals over all buckets that each sweep after the first starts from.
    seen, by_position = [], lm_scoring._by_position
    monkeypatch.setattr(lm_scoring, "_by_position", lambda df: seen.append(by_position(df)) or seen[-1])

    def tables(chunk_bytes):
        lm_scores(docs, train, chunk_bytes=chunk_bytes)
        return seen[-1][0]

    one = tables(1 << 24)
    many = tables(8_000)
    assert many == pytest.approx(one, rel=0.003)
    after_sweeps = [x[0] for x in seen[-lm_scoring.SWEEPS :]]
    assert len(seen) == 2 * (lm_scoring.SWEEPS + 1) and all(x == pytest.approx(many, rel=0.02) for x in after_sweeps)


def test_executors_keep_no_arrow_buffers(spark):
    """What Spark's side of the grouped functions allocates is free when they end, however many tasks there were."""
    docs = documents(spark, [(k, f"a{k % 7} b{k % 5} c{k}", "en", "s") for k in range(60)])
    allocator = spark.sparkContext._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    before = allocator.getAllocatedMemory()
    assert lm_scores(docs, F.lit(True), chunk_bytes=100).count() == 60
    assert allocator.getAllocatedMemory() <= before


def test_packed_numbers_come_back_and_take_less_room():
    rng = np.random.default_rng(11)
    for dtype in (np.int32, np.int64, np.float32):
        for n in (0, 1, 7, 5000):
            values = (rng.random(n) * 1e6 - 5e5).astype(dtype)
            back = unpacked(packed(values), dtype)
            assert back.dtype == dtype and np.array_equal(back, values)
    places = np.arange(60_000, dtype=np.int32)[::2]
    assert np.array_equal(unpacked(packed(places), np.int32), places)
    # Numbers of words as a chunk has them: few bits each, in no order.
    numbers = np.minimum(rng.zipf(1.2, 200_000), 300_000).astype(np.int32)
    as_they_are = len(pa.Codec("zstd", compression_level=1).compress(numbers.tobytes(), asbytes=True))
    assert len(packed(numbers)) < 0.95 * as_they_are


def test_no_shuffle_files_stay_behind_a_step(spark):
    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}

    before = shuffle_files()
    rows = spark.range(1000).select((F.col("id") % 7).cast("int").alias("k"))
    written = lm_scoring._written(lm_scoring._by_group(rows, "k", lambda group: group.slice(0, 1), "k int"))
    until = time.time() + 20
    while (left := shuffle_files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and written.count() == 7


def test_numbered_is_unique_in_less_memory():
    rng = np.random.default_rng(7)
    for n, most in ((0, 1), (1, 1), (1000, 5), (1_000_000, 1 << 40)):
        code = rng.integers(0, most, n)
        values, at = np.unique(code, return_inverse=True)
        tracemalloc.start()
        found = numbered(code.copy())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(found[0], values) and np.array_equal(found[1], at)
    # The copy, its order, the sorted values, the numbers: four arrays of eight bytes an element at most.
    assert peak < 4.5 * code.nbytes
