"""Runs and trees against their definitions written out, and the contract's digests on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import awkward, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from wiretide.llm.periodic_runs import find_runs, kept_words, periodic_runs, run_digests, with_repeated_tails
from wiretide.llm.suffix_tree import SuffixTree


def runs_written_out(w, least=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, periods * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (6, 2), (6, 3), (24, 3)]))
@settings(max_examples=400, deadline=None)
def test_runs(w, limits):
    assert find_runs(w, *limits) == runs_written_out(w, *limits)


@given(
    st.lists(st.integers(0, 30), max_size=40),
    st.lists(st.integers(0, 3), min_size=1, max_size=12),
    st.integers(0, 90),
    st.lists(st.integers(0, 3), max_size=20),
)
@settings(max_examples=300, deadline=None)
def test_planted_runs(head, unit, size, tail):
    w = head + (unit * size)[:size] + tail
    assert find_runs(w) == runs_written_out(w)
    runs = find_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert kept_words(w, runs) == [x for i, x in enumerate(w) if i not in dropped]


@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.randoms())
@settings(max_examples=150, deadline=None)
def test_common_extensions_and_ranks(w, rng):
    tree = SuffixTree(w)
    suffixes = sorted(range(len(w)), key=lambda i: w[i:])
    assert [suffixes[r - 1] for r in tree.ranks()] == list(range(len(w)))
    pairs = [(rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)) for _ in range(40)]
    pairs = [(i, j) for i, j in pairs if i != j]
    expected = []
    for i, j in pairs:
        k = 0
        while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        expected.append(k)
    if pairs:
        assert tree.common(*np.array(pairs).T).tolist() == expected


def test_long_texts():
    rng = random.Random(2)
    plain = [rng.randrange(3, 50) for _ in range(20_000)]
    assert find_runs(plain + [0, 1, 2] * 10_000 + plain) == [(20_000, 30_000, 3)]
    (run,) = find_runs([100, *[1, 2, 3] * 30_000, 101])
    assert run == (1, 90_000, 3)
    tree = SuffixTree([1 + k % 2 for k in range(30_000)])
    assert tree.common(np.array([0, 1, 5]), np.array([2, 4, 29_999])).tolist() == [29_998, 0, 1]


def expected(doc_id, text):
    """The contract's columns, written out."""
    w = words(text)
    h, n = zlib.crc32(str("null" if doc_id is None else doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = runs_written_out(w)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *shown, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_digests(spark):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(80))]
        if k % 3:
            w += (rng.sample("xyzuvw", rng.randrange(1, 6)) * 40)[: rng.randrange(20, 90)] + w[:9]
        rows.append((k, rng.choice([" ", "\n", "  "]).join(w), "en", "a"))
    # Two runs of one exponent, and greater exponents that floats in thousandths don't tell apart.
    rows.append((500, " ".join(["a", "b"] * 12 + ["-"] + ["c", "d"] * 12), "en", "a"))
    rows.append((501, " ".join(["p"] * 3001 + ["-"] + ["q", "r"] * 3001 + ["r"]), "en", "a"))
    docs = documents(spark, rows)
    found = run_digests(periodic_runs(with_repeated_tails(docs))).collect()
    assert sorted(map(tuple, found)) == sorted(expected(r[0], r[1]) for r in rows)
    assert sum(r.n_runs > 0 for r in found) > 60
    by_id = {r.doc_id: r for r in found}
    assert (by_id[500].n_runs, by_id[500].start, by_id[500].period) == (2, 0, 2)


def test_awkward_rows(spark):
    texts = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    found = run_digests(periodic_runs(with_repeated_tails(awkward(spark)))).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(key(r) for r in found if r.doc_id != 6) == sorted(key(expected(i, t)) for i, t in texts if i != 6)
    (long,) = [r for r in found if r.doc_id == 6]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 80_000, 2)
    assert len(found) == len(texts)
    assert run_digests(periodic_runs(with_repeated_tails(documents(spark, [])))).collect() == []


@pytest.mark.parametrize("least,periods", [(6, 2), (10, 4)])
def test_other_limits(spark, least, periods):
    text = "x a b a b a b y c c c c c c c c c c z"
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), least, periods).collect()
    assert [(r.start, r.length, r.period) for r in row.runs] == runs_written_out(text.split(), least, periods)
    assert row.n_words == 19
