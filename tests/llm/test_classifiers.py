"""Held-out accuracy of the classifiers, and their treatment of awkward rows."""

from __future__ import annotations

import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wiretide.llm.common import id_remainder
from wiretide.llm import lang_id
from wiretide.llm.lang_id import BUCKETS, UNDETERMINED, Scorer, fit_languages, fit_model, identify, keep_identified, letter_words
from wiretide.llm.quality import DEPTH, fit_quality, fit_trees, group_matrix, keep_good, score_quality, statistics

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_remainder(spark):
    ids = [0, 1, 2, 77, -5, 10**15, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", id_remainder(F.col("i"), 7).alias("r")).collect()
    assert [r.r for r in rows] == [zlib.crc32(b"null" if i is None else str(i).encode()) % 7 for i in ids]


@needs_tables
def test_quality_query(spark):
    got = entry.queries()["op4_quality_classifier"](spark, SF_DIR)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@needs_tables
def test_language_query(spark):
    got = entry.queries()["op8_language_id"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_flat_trees_against_nested_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = fit_trees(x, y)
    scores = model.score(x)
    assert ((scores > 0.5) == y).mean() > 0.95

    def walk(row):
        total = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < 2**DEPTH - 1:
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    assert scores[:50] == pytest.approx([walk(r) for r in x[:50]])


def test_statistics_are_finite():
    groups = group_matrix()
    for text in [b"", b" \n", b"a", b"\n\na\n", "日本語".encode(), b"A" * 100_000]:
        own = statistics(text, groups)
        assert len(own) == len(statistics(b"", groups)) and np.isfinite(own).all()


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame(
        [(1, 0, "x"), (4, 1, "x"), (4, 0, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (99, 1, "x")], "doc_id long, quality int, text string"
    )
    for own in (labels, labels.limit(0)):
        model = fit_quality(docs, own, F.lit(True))
        got = score_quality(docs, model)
        rows = got.collect()
        assert got.columns == ["doc_id", "score", "predicted"] and len(rows) == docs.count()
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        kept = keep_good(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert score_quality(docs.limit(0), model).count() == 0 and keep_good(docs.limit(0), model).count() == 0


def test_languages_of_awkward_rows(spark):
    docs = awkward(spark)
    model = fit_languages(docs, F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    got = identify(docs, model)
    rows = got.collect()
    assert got.columns == ["doc_id", "lang_pred", "score", "rejected"] and len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert {k for k, r in by_id.items() if r.lang_pred == UNDETERMINED} == {1, 2, 3, 8}
    assert all(0 <= r.score <= 1 for r in rows)
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in rows)
    none = fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {UNDETERMINED}
    assert identify(docs.limit(0), model).count() == 0


def test_cached_words_don_t_matter(monkeypatch):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "xyzé"}
    draw = lambda lang, n: ["".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(n)]
    langs = [rng.choice(sorted(letters)) for _ in range(300)]
    model = fit_model([draw(lang, 40) for lang in langs], langs)
    texts = [(" ".join(draw(lang, 30)), lang) for lang in sorted(letters) * 20]
    scorer = Scorer(model)
    found = [scorer.predict(t) for t, _ in texts]
    assert np.mean([f[0] == lang for f, (_, lang) in zip(found, texts, strict=True)]) > 0.9
    monkeypatch.setattr("wiretide.llm.lang_id.CACHED_WORDS", 20)
    small = Scorer(model)
    again = [small.predict(t) for t, _ in texts]
    assert [a[0] for a in again] == [f[0] for f in found]
    assert [a[1] for a in again] == pytest.approx([f[1] for f in found])


def test_unlike_texts_are_rejected():
    rng = random.Random(2)
    pieces = {"aa": ["ba", "da", "ka"], "bb": ["li", "mi", "ni"]}
    draw = lambda p, n: ["".join(rng.choices(p, k=3)) for _ in range(n)]
    langs = ["aa", "bb"] * 150
    model = fit_model([draw(pieces[lang], 40) for lang in langs], langs)
    scorer = Scorer(model)
    for n in (2, 5, 40):
        kept = [not scorer.predict(" ".join(draw(pieces[lang], n)))[2] for lang in langs]
        assert np.mean(kept) > 0.98
    assert all(scorer.predict(" ".join(draw(["zo", "xu", "qy"], 30)))[2] for _ in range(50))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_languages_that_were_not_learnt_are_rejected():
    """Each language left out in turn: its whole texts go, whole texts of the others stay, random letters go."""
    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.1/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    rng = random.Random(3)
    by_lang = {}
    for _, text, lang in rows:
        words = letter_words(text)
        if len(words) >= 20 and len(by_lang.setdefault(lang, [])) < 520:
            by_lang[lang].append((text, rng.sample(words, min(64, len(words)))))
    for out in by_lang:
        known = [lang for lang in by_lang if lang != out]
        model = fit_model([w for lang in known for _, w in by_lang[lang][:400]], [lang for lang in known for _ in by_lang[lang][:400]])
        scorer = Scorer(model)
        rejected = lambda texts: np.mean([scorer.predict(t)[2] for t in texts])
        assert rejected([t for t, _ in by_lang[out][:150]]) > 0.8
        assert rejected([t for lang in known for t, _ in by_lang[lang][400:]]) < 0.02
        noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(100)]
        assert rejected(noise) > 0.95


def test_a_text_is_the_mean_of_its_features():
    """Logits, probability and familiarity written out feature by feature."""
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "cdefgé"}
    draw = lambda lang, n: ["".join(rng.choices(letters[lang], k=rng.randint(1, 9))) for _ in range(n)]
    langs = ["aa", "bb"] * 60
    model = fit_model([draw(lang, 30) for lang in langs], langs)
    for lang in langs[:10]:
        words = draw(lang, 25) + ["é" * 60]
        features = []
        for w in words:
            marked = f"<{w}>".encode()
            grams = [marked] + [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
            features += [zlib.crc32(g) % BUCKETS for g in grams]
        logits = [sum(model.table[f][k] for f in features) / len(features) + model.bias[k] for k in range(2)]
        e = [math.exp(x / model.temperature) for x in logits]
        best = max(range(2), key=lambda k: e[k])
        told, score, rejected = Scorer(model).predict(" ".join(words).upper())
        assert (told, score) == (model.languages[best], pytest.approx(e[best] / sum(e)))
        familiarity = sum(model.familiar[f][best] for f in features) / len(features)
        assert rejected == (familiarity < model.threshold - model.short / math.sqrt(len(features)))


def test_many_languages_and_long_words(spark, monkeypatch):
    """More languages than are learnt: the most frequent are, and nothing fails. A long run of letters is drawn from anywhere in it."""
    monkeypatch.setattr("wiretide.llm.lang_id.FIT_LANGUAGES", 5)
    rows = [(k, f"word{'abcdefghij'[k % 10]} text", f"l{k % 10 if k < 100 else k % 3}", "s") for k in range(200)]
    model = fit_languages(documents(spark, rows), F.lit(True))
    assert model.languages == ["l0", "l1", "l2", "l3", "l4"]
    rng = np.random.default_rng(1)
    word = "".join(chr(0x4E00 + k) for k in range(300))
    starts = {word.index(lang_id._stretch(word, rng)) for _ in range(60)}
    assert len(starts) > 30 and max(starts) > 200 and lang_id._stretch("short", rng) == "short"


def test_documents_helper(spark):
    assert documents(spark, [(1, "a", "en", "s")]).count() == 1
