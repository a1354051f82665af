"""The two near-duplicate operators against comparing everything with everything."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import awkward, documents, sentence, shingles
from pyspark.sql import functions as F

from wiretide.llm import jaccard_join
from wiretide.llm.embedding_dedup import expected_recall, near_duplicates, step_probability
from wiretide.llm.groups import connected_components, perhaps_among
from wiretide.llm.jaccard_join import choose_bands, jaccard_groups, one_of_each_group


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perhaps_among(spark):
    ids = spark.range(0, 3000, 7)
    rows = spark.range(-100, 3000).selectExpr("id", "id * 2 AS other")
    few = {r.id for r in perhaps_among(rows, F.col("id"), ids).collect()}
    assert set(range(0, 3000, 7)) <= few and len(few) < 500
    tight = perhaps_among(rows, F.col("id"), ids, bits=1 << 15)
    assert tight.columns == rows.columns and set(range(0, 3000, 7)) <= {r.id for r in tight.collect()}
    assert perhaps_among(rows, F.col("id"), ids.limit(0)).count() == 0


def brute_texts(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    count, links = [0] * len(sets), []
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets):
            if i != j and (not x and not y or x and y and len(x & y) / len(x | y) >= 0.8):
                count[i] += 1
                links.append((a, b))
    group = components({a for a, _ in sets}, links)
    return sorted((a, group[a], n) for (a, _), n in zip(sets, count, strict=True))


def check_texts(docs):
    rows = docs.collect()
    got = jaccard_groups(docs)
    assert got.columns == ["doc_id", "copy_of", "group_id", "n_links", "kept"]
    found = got.collect()
    assert sorted((r.doc_id, r.group_id, r.n_links) for r in found if r.doc_id is not None) == brute_texts(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in found if r.doc_id is not None)
    left = one_of_each_group(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in found if r.kept}


def test_awkward_texts(spark):
    docs = awkward(spark)
    check_texts(docs)
    nulls = [r for r in jaccard_groups(docs).collect() if r.doc_id is None]
    assert [(r.group_id, r.n_links, r.kept) for r in nulls] == [(None, 0, True)]
    assert jaccard_groups(docs.limit(0)).count() == 0 and one_of_each_group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [400_000, 800])
def test_near_copies(spark, monkeypatch, block):
    """Chains, copies, shared passages and pairs around the threshold; with small blocks in many cells."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(5)
    rows, passage = [], sentence(rng, 60)
    for _ in range(25):
        words = sentence(rng, rng.choice([8, 40, 120, 400])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(100)}"
            rows.append(" ".join(copy))
            words = rng.choice([words, copy])
    rows += [f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}" for _ in range(8)]
    rng.shuffle(rows)
    check_texts(documents(spark, [(3 * k, t, "en", "s") for k, t in enumerate(rows)]))


def test_band_choice():
    for threshold, recall in [(0.8, 0.999), (0.5, 0.99), (0.95, 0.9), (0.8, 0.5)]:
        bands, rows = choose_bands(threshold, recall)
        assert bands * rows <= 256
        assert 1 - (1 - threshold**rows) ** bands >= recall
    assert choose_bands() == (30, 7)


def brute_vectors(rows, cosine=0.98):
    usable = lambda r: (
        r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)
    )
    own = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in rows if usable(r)]
    count, links = [0] * len(own), []
    for i, (a, la, x) in enumerate(own):
        for j, (b, lb, y) in enumerate(own):
            if i != j and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                count[i] += 1
                links.append((a, b))
    group = components({a for a, *_ in own}, links)
    out = [(a, n, group[a]) for (a, *_), n in zip(own, count, strict=True)]
    return sorted(out + [(r.vec_id, 0, r.vec_id) for r in rows if not usable(r)], key=repr)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, id long, n long, block int")


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_in_one_direction(spark, block):
    """Clusters far inside the threshold, in many blocks; recall there is one but for chances far below a millionth."""
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        center = rng.normal(size=16)
        for _ in range(rng.choice([1, 2, 3, 25])):
            rows.append(((center + rng.normal(size=16) * 0.005).tolist(), c % 3))
    rows += rows[:5] + [([2 * x for x in rows[0][0]], rows[0][1])]
    table = vector_table(spark, [(10 * k, v, label) for k, (v, label) in enumerate(rows)])
    got = near_duplicates(table, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute_vectors(table.collect())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [1.0, 0.0], 1),
        (2, [1.0, 0.0], 1),
        (3, [1.0, 0.0], None),
        (4, [1.0, 0.0], 2),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1),
        (10, [None, 1.0], 1),
        (11, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1),
        (12, [1e-42, 0.0], 1),
        (13, [3e38, 0.0], 1),
        (14, [-1.0, 0.0], 1),
    ]
    table = vector_table(spark, rows)
    assert sorted((tuple(r)[:3] for r in near_duplicates(table).collect()), key=repr) == brute_vectors(table.collect())
    assert near_duplicates(table.limit(0)).count() == 0


def test_recall(spark):
    """Pairs right at the threshold: the formula holds, and it promises more than 0.99."""
    assert expected_recall() > 0.99 and 0 < step_probability(1.4) < step_probability(0.2) < 1
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9801
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 1)]
    found = near_duplicates(vector_table(spark, rows)).where("n_links > 0").count()
    assert found >= 0.97 * 600


def test_one_row_of_each_group(spark):
    """Repeated rows, an id with two texts, and rows without an id: one row of each group stays, and none goes without one."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(12)) for x in "abcd")
    rows = [(1, a), (1, a), (5, b), (5, b), (7, c), (8, c), (None, d), (None, d), (None, c)]
    left = one_of_each_group(documents(spark, [(k, t, "en", "s") for k, t in rows])).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(1, a), (5, b), (7, c), (None, d)], key=repr)
    # The texts of one id are one group: (5, b) doesn't stay beside (1, a), whose text id 5 has too.
    left = one_of_each_group(documents(spark, [(k, t, "en", "s") for k, t in [(1, a), (5, a), (5, b), (9, b)]])).collect()
    assert [(r.doc_id, r.text) for r in left] == [(1, a)]


def test_one_of_each_group_keeps_columns_of_any_name(spark):
    """Input columns named like those made inside come back as they were."""
    rows = [(k, sentence(random.Random(k // 3), 30), 7, "x", 3.5, k) for k in range(12)] + [(None, None, 8, "y", 0.5, 99), (50, "", 9, "z", 1.5, 98)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 long, class string, id double, group long").withColumnRenamed("group", "_h1")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[6], rows[9], rows[13]], key=str)


def test_the_stage_stores_each_text_once(spark, monkeypatch):
    stored, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: stored.append(df.dtypes) or write(df))
    docs = documents(spark, [(k, sentence(random.Random(k % 5), 30), "en", "s") for k in range(20)])
    assert jaccard_join.one_of_each_group(docs).count() == 5
    assert all(sum(kind in ("string", "binary") for _, kind in kinds) <= sum(kind == "string" for _, kind in docs.dtypes) for kinds in stored)
