"""Token files: exact round trips, the grammar's rules, stretches, and the library's ids on odd texts."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from wiretide.llm import token_files
from wiretide.llm.re_pair import LEAST, Shard, _bits, _from_bits, compress, expand, frequent_pairs, replace, write_shard
from wiretide.llm.token_files import Encoder, prove_ranks, read_stretch, read_tokens, rewrite_and_digest, token_digests, token_shards, write_token_files
from wiretide.scratch import scratch_path


@given(st.lists(st.integers(0, 3), max_size=80), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_round_trip(ids, least):
    shard = Shard(write_shard(np.array(ids, np.uint32), [None, 7], [0, len(ids)], least))
    assert shard.ids().tolist() == ids
    assert shard.doc_ids == [None, 7]
    for a in range(len(ids)):
        assert shard.ids(a, 5).tolist() == ids[a : a + 5]


def places(symbols, left, right):
    """Places of a pair that don't overlap, from the left, written out."""
    n, i = 0, 0
    while i + 1 < len(symbols):
        hit = symbols[i] == left and symbols[i + 1] == right
        n, i = n + hit, i + (2 if hit else 1)
    return n


@given(st.lists(st.integers(0, 4), min_size=2, max_size=60))
@settings(max_examples=200, deadline=None)
def test_rounds_replace_frequent_pairs_without_overlap(ids):
    symbols, n = np.array(ids, np.int64), 5
    chosen = frequent_pairs(symbols, n, 2)
    counts = {(a, b): places(ids, a, b) for a in range(5) for b in range(5)}
    if max(counts.values()) < 2:
        assert not len(chosen)
        return
    first = divmod(int(chosen[0]), n)
    assert counts[first] == max(counts.values())
    after = replace(symbols, chosen, n)
    assert len(ids) - len(after) == sum(counts[divmod(int(c), n)] for c in chosen)
    # One pair after the other gives the same sequence.
    single = symbols.tolist()
    for r, c in enumerate(chosen.tolist()):
        left, right = divmod(c, n)
        out, i = [], 0
        while i < len(single):
            hit = i + 1 < len(single) and (single[i], single[i + 1]) == (left, right)
            out.append(n + r if hit else single[i])
            i += 2 if hit else 1
        single = out
    assert after.tolist() == single


def test_no_frequent_pair_is_left_and_repeats_get_short():
    rng = random.Random(1)
    ids = np.array([rng.randrange(40) for _ in range(20_000)] * 2, np.uint32)
    g = compress(ids)
    pairs, counts = np.unique(np.stack([g.symbols[:-1], g.symbols[1:]]), axis=1, return_counts=True)
    assert all(c < LEAST or a == b for (a, b), c in zip(pairs.T, counts, strict=True))
    assert (expand(g, g.symbols) == ids).all()
    same = np.full(1 << 16, 5, np.uint32)
    assert len(write_shard(same, [1], [len(same)])) < 400


@given(st.lists(st.integers(0, 6), min_size=2, max_size=400), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_rounds_over_marked_places_make_the_same_grammar(ids, least):
    symbols, n, rules = np.array(ids, np.int64), 7, []
    live = np.ones(len(symbols), bool)
    marked = symbols
    while len(symbols) > 1 and len(chosen := frequent_pairs(symbols, n, least)):
        assert frequent_pairs(marked, n, least, live).tolist() == chosen.tolist()
        places_of = {}
        for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
            places_of.setdefault(pair, []).append(i)
        assert all(live[places].all() for places in places_of.values() if len(places) >= least)
        symbols, marked = replace(symbols, chosen, n), replace(marked, chosen, n, live)
        live = live[: len(marked)]
        assert marked.tolist() == symbols.tolist()
        rules, n = rules + [divmod(c, n) for c in chosen.tolist()], n + len(chosen)
    named = {t: k for k, t in enumerate(sorted(set(ids)))}
    g = compress(np.array(ids, np.uint32), least)
    assert len(g.rules) == len(rules) and len(g.symbols) == len(symbols)
    assert expand(g, g.symbols).tolist() == ids and len(g.terminals) == len(named)


def test_places_of_rare_pairs_are_left_out():
    rng = random.Random(8)
    ids = np.array([rng.randrange(1000, 30_000) for _ in range(20_000)] + [1, 2] * 50, np.uint32)
    live = np.ones(len(ids), bool)
    assert frequent_pairs(ids, 30_000, LEAST, live).tolist()[0] == 30_002
    assert live[20_000:-2].all() and live[:20_000].sum() < 200


@pytest.mark.parametrize("width", [1, 7, 13, 16, 31, 32])
def test_bits_lie_lowest_first(width):
    rng = random.Random(width)
    for n in (0, 1, 63, 64, 65, 1000):
        values = [rng.randrange(1 << width) for _ in range(n)]
        whole = sum(v << (k * width) for k, v in enumerate(values))
        data = _bits(np.array(values, np.int64), width)
        assert data == whole.to_bytes((n * width + 7) // 8, "little")
        assert _from_bits(memoryview(data), 0, n, width).tolist() == values
        assert _from_bits(memoryview(data), 64, max(0, n - 64), width).tolist() == values[64:]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(None)


def test_ids_equal_the_librarys(encoder):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\u2003", "'s", "'re", "a", "B", " b", "é", "日", "1", "２", "!", "\x85", "\xa0", "<|endoftext|>", "'", "\x1c", "\u0301"]
    parts += ["\u180e", "\u200b", "\U0001fae0", "\ua7c2", "\U0001f600", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (500, 20_000)]
    texts += ["".join(map(chr, rng.choices(range(0x3000), k=40))) for _ in range(2000)]
    assert encoder.ranked is not None
    assert [encoder.ids(t).tolist() for t in texts] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_many_texts_in_small_blocks_equal_the_librarys(encoder, monkeypatch):
    rng = random.Random(9)
    words = ["the", " end", "'s", "'ll", "'", "don't", "  ", " ", "\n", "\n\n", "\t", "É", " ß", "12", " 7", "!?", "\u3000", "<|endoftext|>", "\U0001fae0", "x" * 70]
    texts = ["".join(rng.choice(words[:-3]) for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)] + [""] * 30
    rng.shuffle(texts)
    monkeypatch.setattr(token_files, "BLOCK_CHARS", 150)
    monkeypatch.setattr(token_files, "HELD_CHARS", 2000)
    assert max(len(encoder.parts(t)) for t in texts) > 3
    assert [i.tolist() for i in encoder.many(texts)] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_the_library_merges_each_chunk_once():
    rng = random.Random(10)
    words = ["".join(rng.choice("qxzjkv") for _ in range(9)) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(200)]
    encoder = token_files.Encoder(None)
    library, merged = encoder.library, []

    class Counting:
        class model:  # noqa: N801
            @staticmethod
            def tokenize(letters):
                merged.append(letters)
                return library.model.tokenize(letters)

    encoder.library = Counting
    assert [i.tolist() for i in encoder.many(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(merged) == len(set(merged)) <= 80


def test_ranks_need_their_proof(encoder):
    settings = json.loads(encoder.library.to_str())
    alone = lambda t: len(encoder.library.model.tokenize(t))
    assert len(prove_ranks(settings, alone)) == 50_256
    assert prove_ranks(settings | {"normalizer": {"type": "NFC"}}, alone) is None
    assert prove_ranks(settings | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, alone) is None
    assert prove_ranks(settings | {"pre_tokenizer": None}, alone) is None
    assert prove_ranks(settings, lambda t: 2) is None
    model = settings["model"]
    assert prove_ranks(settings | {"model": model | {"merges": model["merges"][::-1]}}, alone) is None
    assert prove_ranks(settings | {"model": model | {"type": "Unigram"}}, alone) is None


def test_another_tokenizer_goes_to_the_library():
    import public_tokenizers

    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranked is None
    assert other.ids("One two!").tolist() == other.library.encode("One two!", add_special_tokens=False).ids


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_awkward_rows(spark, encoder):
    found = rewrite_and_digest(awkward(spark)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    texts = {r.doc_id: r.text for r in awkward(spark).collect()}
    assert [tuple(r) for r in found] == expected([(r.doc_id, texts[r.doc_id]) for r in found], encoder.library)
    assert rewrite_and_digest(documents(spark, [])).collect() == []


def test_files_shards_and_stretches(spark, encoder):
    rng = random.Random(5)
    rows = [(k, sentence(rng, rng.randrange(60), 50)) for k in range(300)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")
    folder = scratch_path(spark)
    write_token_files(docs, folder, shard_ids=500)
    shards = token_shards(spark, folder).orderBy("first").collect()
    assert len(shards) > 8
    assert all(a.first + a.n_ids == b.first for a, b in zip(shards, shards[1:], strict=False))
    assert [tuple(r) for r in token_digests(spark, folder).orderBy("start").collect()] == expected(rows, encoder.library)
    all_ids = [i for _, text in rows for i in [*encoder.library.encode(text, add_special_tokens=False).ids, 0]]
    read = read_tokens(spark, folder).orderBy("start").collect()
    assert [i for r in read for i in r.ids] == all_ids and [r.doc_id for r in read] == list(range(300))
    for start, length in ((0, 1), (490, 30), (1234, 3000), (len(all_ids) - 3, 100), (len(all_ids), 5)):
        parts = read_stretch(spark, folder, start, length).orderBy("first").collect()
        assert [i for p in parts for i in np.frombuffer(p.ids, "<u4").tolist()] == all_ids[start : start + length]


def test_one_id_for_a_third_of_all_rows_spreads(spark, encoder):
    rng = random.Random(6)
    rows = [(7 if k % 3 == 0 else k, sentence(rng, 30, 500)) for k in range(1200)]
    folder = scratch_path(spark)
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, shard_ids=200)
    docs = {}
    for s in token_shards(spark, folder).collect():
        docs[s.part] = docs.get(s.part, 0) + s.n_docs
    assert sum(docs.values()) == 1200 and max(docs.values()) < 600
    got = token_digests(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    crc = lambda t: zlib.crc32(np.array([*encoder.library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((i, crc(t)) for i, t in rows)
