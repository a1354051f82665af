from __future__ import annotations

import base64
import hashlib
import random

import pytest
import xxhash
from helpers import awkward, documents, sentence, shingles, words
from pyspark.sql import functions as F

from wiretide.llm.common import words_of
from wiretide.llm.fingerprints import (
    K,
    bottom,
    containment,
    distinct_shingles,
    fingerprint_documents,
    merge,
    merge_parts,
    order_part,
    resemblance,
    sketch,
)


def hashes(text):
    """Hashes of the shingles as chained by Spark's xxhash64, which starts from the seed 42."""
    out = set()
    for s in shingles(text):
        h = 42
        for w in s:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out)


def written(own):
    return base64.b64encode(b"".join(h.to_bytes(8, "big", signed=True) for h in own[:K])).decode()


def likeness(a, b):
    both = sorted(set(a) | set(b))[:K]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def number(own):
    return float(len(own)) if len(own) < K else (K - 1) / ((own[-1] + 2.0**63) / 2.0**64)


def kept_share(a, b):
    both = sorted(set(a) | set(b))[:K]
    return min(1.0, likeness(a, b) * number(both) / number(a)) if a else 1.0


def check(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    expected = []
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (hashes(t)[:K] for t in (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((r.doc_id, len(text), sha, written(a), written(b), likeness(a, b), likeness(a, c), number(a), kept_share(a, b)))
    found, expected = sorted(map(tuple, fingerprint_documents(docs).collect()), key=repr), sorted(expected, key=repr)
    assert [r[:7] for r in found] == [r[:7] for r in expected]
    assert [x for r in found for x in r[7:]] == pytest.approx([x for r in expected for x in r[7:]])


def test_awkward_rows(spark):
    check(awkward(spark))


def test_whole_query_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12) - 10**11, sentence(rng, rng.choice([0, 1, 4, 5, 6, 60, 700])), "en", "s") for _ in range(150)]
    rows += [(10**13 + k, rows[k % 7][1], "en", "s") for k in range(30)]
    check(documents(spark, rows).repartition(7))


def test_one_row_and_none(spark):
    docs = documents(spark, [(5, "a b c d e f g h", "en", "s")])
    check(docs)
    assert fingerprint_documents(docs.limit(0)).count() == 0


def test_estimates_and_merging(spark):
    rng = random.Random(2)
    w = [f"v{k}" for k in range(6000)]
    rng.shuffle(w)
    a, b = " ".join(w[:4000]), " ".join(w[1000:6000])
    rows = spark.createDataFrame([(a, b)], "a string, b string").select("a", "b", words_of(F.col("a")).alias("wa"), words_of(F.col("b")).alias("wb"))
    rows = rows.select("a", "b", sketch(F.col("wa")).alias("x"), sketch(F.col("wb")).alias("y"))
    r = rows.select(
        resemblance(F.col("x"), F.col("y")).alias("j"),
        containment(F.col("x"), F.col("y")).alias("c"),
        distinct_shingles(F.col("x")).alias("n"),
        merge(F.col("x"), F.col("y")).alias("m"),
    ).first()
    sa, sb = shingles(a), shingles(b)
    assert abs(r.j - len(sa & sb) / len(sa | sb)) < 0.15
    assert abs(r.c - len(sa & sb) / len(sa)) < 0.25
    assert abs(r.n / len(sa) - 1) < 0.35
    assert r.m == sorted({*hashes(a), *hashes(b)})[:K]


def test_merge_parts(spark):
    rng = random.Random(3)
    texts = [(k % 3 if k % 5 else None, sentence(rng, 80)) for k in range(40)] + [(9, "")]
    rows = spark.createDataFrame(texts, "key int, text string").select("key", words_of(F.col("text")).alias("w"))
    got = {r.key: r.sketch for r in merge_parts(rows.select("key", sketch(F.col("w")).alias("sketch")), "key").collect()}
    expected = {}
    for key, text in texts:
        expected.setdefault(key, set()).update(hashes(text))
    assert got == {k: sorted(v)[:K] for k, v in expected.items()}


def test_no_words_and_short_texts(spark):
    rows = spark.createDataFrame([("",), (" \n",), ("a",), ("a b c d",)], "t string").select("t", words_of(F.col("t")).alias("w"))
    got = {r.t: r.s for r in rows.select("t", sketch(F.col("w")).alias("s")).collect()}
    assert got == {"": [], " \n": [], "a": hashes("a"), "a b c d": hashes("a b c d")}
    assert words("a b c d") == ["a", "b", "c", "d"]


def test_order_part(spark):
    cuts = list(range(0, 300, 7))
    rows = spark.range(-5, 320).select("id", order_part(F.col("id"), cuts).alias("p"), bottom(F.array("id")).alias("b"))
    assert all(r.p == sum(c < r.id for c in cuts) for r in rows.collect())
