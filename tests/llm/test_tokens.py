"""Token counts and packing against the libraries on whole texts."""

from __future__ import annotations

import collections
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, sentence

from wiretide.llm import packing, token_counts
from wiretide.llm.packing import Encoder, Packer, pack_documents
from wiretide.llm.token_counts import TokenCounter, count_tokens, prove_shortcut

PARTS = [" ", "  ", "\n", "a", "The", "▁", "é", "日", ".", "\t", "'s", "<s>", "x9", "\x00", "\xa0", "<|endoftext|>", "İ", "ß", "ÀÉ", "_", "é"]


def odd_texts(n=1500):
    rng = random.Random(3)
    return ["", *("".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(n))]


@pytest.mark.parametrize("cache", [400_000, 3])
def test_counts_equal_the_library(monkeypatch, cache):
    monkeypatch.setattr(token_counts, "CACHED_PRETOKENS", cache)
    proven = prove_shortcut()
    assert proven is not None and len(proven[0]) > 10_000
    counter, whole = TokenCounter(None, proven), TokenCounter(None, None)
    assert [counter(t) for t in odd_texts()] == [whole(t) for t in odd_texts()]


@pytest.mark.parametrize("cache", [500_000, 3])
def test_ids_equal_the_library(monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", cache)
    encoder = Encoder(None)
    for text in odd_texts():
        assert encoder.ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


def test_chunks_that_come_again_stay_when_the_cache_is_full(monkeypatch):
    """Frequent words among ever new ones are merged once, and the cache has its bound."""
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 60)
    encoder = Encoder(None)
    merged, merge = [], encoder.merge
    encoder.merge = lambda letters: merged.append(letters) or merge(letters)
    names = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(600)]
    common, new = names[:10], iter(names[10:])
    for _ in range(50):
        text = " ".join([*common, *(next(new) for _ in range(10)), "Aaaa,"])
        assert encoder.ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids
        assert len(encoder.chunks) + len(encoder.chunks.old) <= 2 * 60
    assert all(merged.count(word) == 1 for word in common) and len(set(merged)) == 511


def test_tasks_of_a_worker_share_the_encoder():
    assert packing.encoder_of(None) is packing.encoder_of(None)


def test_no_chunks_are_kept_after_a_task(spark):
    """A worker goes on to other operators, whose memory its chunks would take."""
    texts = [" ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k, k + 40)) for k in range(300)]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])

    def kept(batches):
        for _ in batches:
            chunks = packing.encoder_of(None).chunks
            yield pa.RecordBatch.from_arrays([pa.array([len(chunks) + len(chunks.old)])], names=["n"])

    assert len(pack_documents(docs.coalesce(1)).collect()) >= 300
    assert {r.n for r in spark.range(8).coalesce(1).mapInArrow(kept, "n long").collect()} == {0}


def test_counts_of_awkward_rows(spark):
    docs = awkward(spark)
    whole = TokenCounter(None, None)
    rows = docs.collect()
    got = count_tokens(docs, limit=5)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r.doc_id, len((r.text or "").encode()), whole(r.text or ""), whole(r.text or "") > 5) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert count_tokens(docs.limit(0)).count() == 0


def check_pieces(rows, ids_of, window=2048):
    """Every id in one piece, sequences gapless, and the padding."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert set(by_doc) == set(ids_of)
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for _, start, length, crc, n, _, _ in sorted(pieces, key=lambda p: p[1]):
            assert start == at and length > 0 and n == len(ids) and crc == zlib.crc32(ids[at : at + length].astype("<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


@pytest.mark.parametrize("most", [8192, 5])
def test_packer(monkeypatch, most):
    monkeypatch.setattr(packing, "MAX_OPEN", most)
    rng = np.random.default_rng(1)
    ids = {k: rng.integers(0, 2**32, n, dtype=np.uint32) for k, n in enumerate([1, 2048, 4096, 4097, *rng.integers(1, 6000, 500)])}
    packer = Packer(0)
    for k, own in ids.items():
        packer.add(k, own)
    packer.drain()
    assert check_pieces(packer.rows, ids) == 0


def test_the_fuller_half_is_cut_at_the_bound(monkeypatch):
    """Windows that nothing fits into any more: at the bound the fullest are cut, and the others stay open."""
    monkeypatch.setattr(packing, "MAX_OPEN", 40)
    packer, ids = Packer(0), {}
    for k in range(41):
        ids[k] = np.arange(1100 + k, dtype=np.uint32)
        packer.add(k, ids[k])
    assert packer.n_open == packer.counts.sum() == 20
    assert max(np.flatnonzero(packer.counts)) < 1100 + 20
    packer.drain()
    assert packer.n_open == packer.counts.sum() == 0 and check_pieces(packer.rows, ids) == 0


def test_the_shortcut_needs_its_rules():
    encoder = Encoder(None)
    settings = json.loads(encoder.library.to_str())
    assert encoder.proven and Encoder.proved(settings)
    for key, value in [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 5}), ("padding", {"x": 1})]:
        assert not Encoder.proved(settings | {key: value})
    assert not Encoder.proved(settings | {"model": settings["model"] | {"type": "Unigram"}})
    assert not Encoder.proved(settings | {"added_tokens": [{"content": "a b"}]})
    import public_tokenizers

    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["One two  three", "É\n\n ß, 12 <|endoftext|>", ""]
    assert not other.proven
    assert [other.ids(t).tolist() for t in texts] == [other.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(2)
    for _ in range(200):
        packer = Packer(0, window=16)
        for level in range(1, 16):
            packer.counts[level] = rng.choice([0, 0, 1, 3])
        size = rng.randrange(1, 16)

        def after(level, packer=packer, size=size):
            counts = packer.counts.copy()
            counts[level] -= bool(level)
            counts[level + size] += level + size < 16
            return (counts**2).sum()

        allowed = [0, *(h for h in range(1, 17 - size) if packer.counts[h])]
        assert after(packer.best_level(size)) == min(map(after, allowed))


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    encoder = Encoder(None)
    ids = {r.doc_id: np.append(encoder.ids(r.text or ""), 1).astype("<u4") for r in docs.collect()}
    once = docs.dropDuplicates(["doc_id"])
    packed = pack_documents(once)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_pieces(packed.collect(), ids) == 0
    repeated = pack_documents(docs).where("doc_id = 4 AND start = 0").count()
    assert repeated == 2
    assert pack_documents(docs.limit(0)).count() == 0


def test_packing_reruns_agree(spark):
    rng = random.Random(4)
    docs = documents(spark, [(k, sentence(rng, rng.randrange(1, 900)), "en", "s") for k in range(60)])
    assert sorted(pack_documents(docs).collect()) == sorted(pack_documents(docs).collect())
