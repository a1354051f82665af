"""Language-model scoring: a hierarchical Pitman-Yor model over words, seated by Gibbs sampling.

Each context has a Chinese restaurant whose customers are the words that follow it; all of them share one parent, the
restaurant of words without a context, whose base is uniform over the known words and one for all unknown ones. Every
word is a context of its own, and so is the start of a text. Discounts come from how many words were seen once and twice.

How it runs: texts become chunks (local vocabulary and token numbers), written once. A chunk sends what it needs (its distinct pairs of
context and word, with their training counts) to the buckets of its words. A bucket holds all customers of its words, so
it can seat them in all restaurants and in the parent by itself; it needs the others only for the numbers of tables of the contexts it
has, which are added up per context in shards of their own (``added_up``). After the last sweep it sends each chunk the probabilities of the
pairs it asked for, averaged over the samples, and the chunk scores its texts. Work and traffic grow with the distinct pairs per chunk; no task,
and not the driver, holds the vocabulary or the contexts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import _delete, scratch_path, shuffles_dropped
from .common import pieces

#: Keys, among the hashes of words, of the context of all words that a model doesn't name, and of the start of a text.
OTHERS, START = 0, 1
#: Bytes of text in a chunk, and buckets at most (else as many as chunks).
CHUNK_BYTES, MAX_BUCKETS = 16 << 20, 20_000
STRENGTH = 1.0
SWEEPS, BURN_IN = 5, 2
#: Customers of a dish up to which the numbers behind its law are exact; beyond, they come from a saddle point (within 1 % for discounts
#: of 0.5 or more, within 5 % from 0.3 on, at fewest tables).
EXACT = 1024
SEED = 3
END = b""

CHUNKS = "chunk long, n_docs int, doc_ids binary, lengths binary, train binary, tokens binary, hashes binary"
REQUESTS = "bucket int, chunk long, n_words int, words binary, per_word binary, keys binary, contexts binary, counts binary"
BUCKETS = "bucket int, keys binary, cut binary, tables binary, customers binary, per_word binary, contexts binary, counts binary, chunks binary, n_words binary, n_pairs binary, word_at binary, pair_at binary, sums array<bigint>"
REPLIES = "chunk long, bucket int, word_counts binary, chances binary"
STATES = "bucket int, cut binary, tables binary, pair_tables binary, parent_tables binary, in_context binary, kept_pairs binary, kept_parents binary, kept_contexts binary, kept_totals binary, sums array<double>"
SEATING = ["pair_tables", "parent_tables", "in_context", "kept_pairs", "kept_parents", "kept_contexts", "kept_totals"]
ASKED = "asker int, shard int, keys binary, customers binary"
PLACES = "shard int, askers binary, sizes binary, places binary, asker int, customers binary"
PARTS = "asker int, shard int, tables binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Compressed with the lowest bytes of all values first, then the next ones: the high bytes of small numbers are long runs of zeros."""
    values = np.ascontiguousarray(values)
    data = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpacked(data: bytes, dtype) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size // width).T).reshape(-1).view(dtype)


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0).astype(np.int32)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(n_buckets)).astype(np.int32)


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and where each element's is among them: ``np.unique`` in half its memory. Sorts ``code`` in place."""
    order = np.argsort(code)
    code[:] = code[order]
    new = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=new[1:])
    values = code[new]
    number = new.cumsum(dtype=np.int32)
    number -= 1
    at = np.empty(len(code), np.int32)
    at[order] = number
    return values, at


@dataclass
class Model:
    """What a task needs besides its own bucket or chunk: the totals, and of the contexts those of the bucket or chunk."""

    context_hashes: np.ndarray  # ascending
    n_buckets: int
    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    parent_discount: float = 0.5
    customers: np.ndarray | None = None  # per context
    tables: np.ndarray | None = None
    parent_customers: float = 0.0
    parent_tables: float = 0.0

    @property
    def n_contexts(self) -> int:
        return len(self.context_hashes) + 2

    @property
    def keys(self) -> np.ndarray:
        return np.append(self.context_hashes, [OTHERS, START]).astype(np.int64)

    @property
    def uniform(self) -> float:
        return 1 / (self.words + 1)


class ChunkBuilder:
    def __init__(self, first: int):
        self.chunk = first
        self.start()

    def start(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[END]  # number 0
        self.docs, self.train, self.tokens, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes, train: bool) -> None:
        words = text.lower().split()
        words.append(END)
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.train.append(train)
        self.bytes += len(text)

    def finish(self) -> dict:
        lengths = np.array([len(t) for t in self.tokens], np.int32)
        tokens = np.concatenate(self.tokens)
        vocabulary = list(self.ids)
        hashes = np.fromiter(map(word_hash, vocabulary), np.int64, len(vocabulary))
        counts = np.bincount(tokens[np.repeat(np.array(self.train), lengths)], minlength=len(vocabulary))
        counts[0] = 0
        top = np.lexsort((hashes, -counts))
        top = top[counts[top] > 0]
        out = {
            "chunk": self.chunk,
            "n_docs": len(lengths),
            # Null ids are told by their bytes.
            "doc_ids": b"".join(b"\1" + d.to_bytes(8, "little", signed=True) if d is not None else b"\0" * 9 for d in self.docs),
            "lengths": packed(lengths),
            "train": np.array(self.train, bool).tobytes(),
            "tokens": packed(tokens),
            "hashes": hashes.tobytes(),
            "top_hash": hashes[top].tolist(),
        }
        self.chunk += 1
        self.start()
        return out


class Chunk:
    """A chunk's tokens as pairs of a word and a context, in the order of (bucket, word hash, context)."""

    def __init__(self, row: dict, model: Model):
        self.lengths = unpacked(row["lengths"], np.int32)
        self.train = np.frombuffer(row["train"], bool)
        tokens = unpacked(row["tokens"], np.int32)
        hashes = np.frombuffer(row["hashes"], np.int64)
        buckets = bucket_of(hashes, model.n_buckets)
        order = np.lexsort((hashes, buckets))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.buckets = hashes[order], buckets[order]
        n_own = len(model.context_hashes)
        contexts = np.full(len(hashes), n_own)
        if n_own:
            at = np.minimum(np.searchsorted(model.context_hashes, hashes), n_own - 1)
            contexts = np.where(model.context_hashes[at] == hashes, at, contexts)
        self.starts = np.concatenate([[0], self.lengths.cumsum()[:-1]]).astype(np.int64)
        self.token_word = rank.astype(np.int32)[tokens]
        code = rank[tokens]
        code *= model.n_contexts
        code[1:] += contexts[tokens[:-1]]
        code[self.starts] = self.token_word[self.starts].astype(np.int64) * model.n_contexts + model.n_contexts - 1
        del tokens
        pairs, self.token_pair = numbered(code)
        self.pair_word, self.pair_context = np.divmod(pairs, model.n_contexts)

    def requests(self, chunk: int, model: Model) -> Iterator[dict]:
        train = np.repeat(self.train, self.lengths)
        counts = np.bincount(self.token_pair[train], minlength=len(self.pair_word)).astype(np.int32)
        present = np.unique(self.buckets)
        word_cut = np.searchsorted(self.buckets, np.append(present, present[-1] + 1))
        pair_cut = np.searchsorted(self.pair_word, word_cut)
        per_word = np.bincount(self.pair_word, minlength=len(self.hashes)).astype(np.int32)
        for k, bucket in enumerate(present.tolist()):
            words, pairs = slice(word_cut[k], word_cut[k + 1]), slice(pair_cut[k], pair_cut[k + 1])
            yield {
                "bucket": bucket,
                "chunk": chunk,
                "n_words": words.stop - words.start,
                "words": self.hashes[words].tobytes(),
                "per_word": packed(per_word[words]),
                "contexts": packed(self.pair_context[pairs].astype(np.int32)),
                "counts": packed(counts[pairs]),
            }

    def scores(self, replies: list[dict], model: Model) -> dict[str, np.ndarray]:
        """``replies`` in the order of buckets."""
        word_counts = np.concatenate([unpacked(r["word_counts"], np.int64) for r in replies])
        chances = np.concatenate([unpacked(r["chances"], np.float32) for r in replies]).astype(np.float64)
        base = np.log10((word_counts + 1) / (model.tokens + model.words + 1))
        add = lambda per_token: np.add.reduceat(per_token, self.starts)
        return {
            "n_known": add((word_counts > 0).astype(np.int64)[self.token_word]),
            "base_score": add(base[self.token_word]),
            "score": add(np.log10(chances)[self.token_pair]),
        }


def merge_bucket(requests: list[dict], n_contexts: int) -> dict:
    """All chunks' pairs of one bucket, added up, and where each chunk's words and pairs are among them."""
    n_words = np.array([r["n_words"] for r in requests], np.int64)
    per_word = [unpacked(r["per_word"], np.int32) for r in requests]
    contexts = [unpacked(r["contexts"], np.int32) for r in requests]
    n_pairs = np.array([len(c) for c in contexts], np.int64)
    words, word_at = np.unique(np.concatenate([np.frombuffer(r["words"], np.int64) for r in requests]), return_inverse=True)
    code = np.repeat(word_at, np.concatenate(per_word)).astype(np.int64) * n_contexts + np.concatenate(contexts)
    pairs, pair_at = numbered(code)
    counts = np.bincount(pair_at, np.concatenate([unpacked(r["counts"], np.int32) for r in requests]), len(pairs)).astype(np.int64)
    pair_word, pair_context = np.divmod(pairs, n_contexts)
    seen = counts > 0
    tables = np.bincount(pair_context[seen], minlength=n_contexts)
    customers = np.bincount(pair_context, counts, n_contexts).astype(np.int64)
    in_contexts = np.bincount(pair_word[seen], minlength=len(words))
    totals = [counts.sum(), (in_contexts > 0).sum(), (counts == 1).sum(), (counts == 2).sum(), (in_contexts == 1).sum(), (in_contexts == 2).sum()]
    word_cut, pair_cut = np.append(0, n_words.cumsum()), np.append(0, n_pairs.cumsum())
    by_chunk = lambda at, cut: np.concatenate([steps(at[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return {
        "bucket": requests[0]["bucket"],
        "per_word": packed(np.bincount(pair_word, minlength=len(words)).astype(np.int32)),
        "contexts": packed(pair_context.astype(np.int32)),
        "counts": packed(counts),
        "chunks": np.array([r["chunk"] for r in requests], np.int64).tobytes(),
        "n_words": n_words.tobytes(),
        "n_pairs": n_pairs.tobytes(),
        "word_at": packed(by_chunk(word_at, word_cut)),
        "pair_at": packed(by_chunk(pair_at, pair_cut)),
        "sums": [int(x) for x in (*tables, *customers, *totals)],
    }


def own_model(row: dict, model: Model) -> Model:
    """The model of one chunk: all its words are contexts."""
    return replace(model, context_hashes=np.unique(np.frombuffer(row["hashes"], np.int64)))


def with_keys(request: dict, model: Model) -> dict:
    """The same request, with the contexts counted among those it has, which are known by their keys elsewhere."""
    used, at = np.unique(unpacked(request["contexts"], np.int32), return_inverse=True)
    return {**request, "keys": model.keys[used].tobytes(), "contexts": packed(at.astype(np.int32))}


def merge_by_keys(requests: list[dict], n_shards: int) -> dict:
    """``merge_bucket`` for requests that have their own contexts each; tables and customers are of the bucket's contexts.

    The contexts are in the order of (shard, key), and ``cut`` has their number per shard.
    """
    each = [np.frombuffer(r["keys"], np.int64) for r in requests]
    ascending = np.unique(np.concatenate(each))
    shards = bucket_of(ascending, n_shards)
    order = np.argsort(shards, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    same = [packed(place[np.searchsorted(ascending, own)][unpacked(r["contexts"], np.int32)]) for own, r in zip(each, requests, strict=True)]
    n = len(order)
    merged = merge_bucket([{**r, "contexts": c} for r, c in zip(requests, same, strict=True)], n)
    tables, customers = (np.array(merged["sums"][a : a + n], np.int64) for a in (0, n))
    cut = np.bincount(shards, minlength=n_shards).astype(np.int32)
    own = {"keys": ascending[order].tobytes(), "cut": packed(cut), "tables": packed(tables), "customers": packed(customers)}
    return {**merged, **own, "sums": [*merged["sums"][2 * n :], int(tables.sum())]}


def by_shard(cut: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(shard, its part of each column) for the shards that a bucket has contexts in."""
    ends = np.cumsum(cut)
    for shard in np.flatnonzero(cut).tolist():
        yield shard, *[c[ends[shard] - cut[shard] : ends[shard]] for c in columns]


def places_of_shard(asked: list[dict]) -> list[dict]:
    """Where each asker's contexts are among all of a shard's, written down once; and, for each asker, the customers over all askers."""
    each = [np.frombuffer(a["keys"], np.int64) for a in asked]
    _, at = np.unique(np.concatenate(each), return_inverse=True)
    sizes = np.array([len(k) for k in each], np.int64)
    customers = np.bincount(at, np.concatenate([unpacked(a["customers"], np.int64) for a in asked])).astype(np.int64)
    parts = np.split(at, np.cumsum(sizes)[:-1])
    askers = np.array([a["asker"] for a in asked], np.int32)
    first = {"shard": asked[0]["shard"], "askers": askers.tobytes(), "sizes": sizes.tobytes(), "places": packed(np.concatenate([steps(p) for p in parts]))}
    return [first, *({"shard": a["shard"], "asker": a["asker"], "customers": packed(customers[p])} for a, p in zip(asked, parts, strict=True))]


def add_shard(places: dict, parts: list[dict]) -> list[dict]:
    """For each asker, the tables of its contexts over all askers."""
    askers, sizes = np.frombuffer(places["askers"], np.int32).tolist(), np.frombuffer(places["sizes"], np.int64)
    moves = np.split(unpacked(places["places"], np.int32), np.cumsum(sizes)[:-1])
    at = {asker: m.cumsum() for asker, m in zip(askers, moves, strict=True)}
    here = np.concatenate([at[p["asker"]] for p in parts])
    sums = np.bincount(here, np.concatenate([unpacked(p["tables"], np.int64) for p in parts])).astype(np.int64)
    return [{"asker": p["asker"], "shard": p["shard"], "tables": packed(sums[at[p["asker"]]])} for p in parts]


def from_shards(replies: list[dict], column: str) -> np.ndarray:
    """A bucket's contexts lie in the order of shards, as do the replies."""
    found = [unpacked(r[column], np.int64) for r in sorted(replies, key=lambda r: r["shard"]) if r[column] is not None]
    return np.concatenate(found).astype(np.float64)


def stirling_ratios(discount: float, upto: int) -> np.ndarray:
    """S(c, t + 1) / S(c, t) for c = 2 ... upto customers and t = 1 ... c - 1, one after the other.

    S(c, t) is the weight of all ways to seat c customers of one dish at t tables: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t).
    """
    out = np.zeros(upto * (upto - 1) // 2)
    ratio = np.zeros(0)  # of one customer: nothing after the first table
    for c in range(1, upto):
        t = np.arange(1, c + 1)
        after = np.append(ratio, 0.0)
        before = np.divide(1.0, ratio, out=np.zeros(c - 1), where=ratio > 0)
        ratio = (1 + (c - discount * (t + 1)) * after) / (np.concatenate([[0.0], before]) + c - discount * t)
        out[c * (c - 1) // 2 : c * (c + 1) // 2] = ratio
    return out


def ratios_of(table: np.ndarray, c: int) -> np.ndarray:
    return table[(c - 1) * (c - 2) // 2 : c * (c - 1) // 2]


def far_ratio(customers: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """About S(c, t + 1) / S(c, t) for many customers: the saddle point of (1 - (1 - z)^discount)^t / z^c, by bisection on log(1 - z)."""
    low, high = np.full(len(t), -700.0), np.zeros(len(t))
    for _ in range(60):
        middle = (low + high) / 2
        f = -np.expm1(discount * middle)
        z = -np.expm1(middle)
        # t z f'(z) / f(z) falls as 1 - z rises.
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            reach = t * z * discount * np.exp((discount - 1) * middle) / f
        above = reach > customers
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return -np.expm1(discount * (low + high) / 2) / (discount * t)


def seat(
    customers: np.ndarray,
    strength: np.ndarray,
    per_table: np.ndarray,
    discount: float,
    rng,
    parent: tuple[np.ndarray, np.ndarray] | None = None,
    ratios: np.ndarray | None = None,
) -> np.ndarray:
    """Numbers of tables of dishes with so many customers, drawn anew given all else.

    The law of a seating is the product over its customers of ``strength + per_table * tables`` for one that opens a table after the first, and
    of customers seated less the discount per table for one that joins. So t tables have the weight S(c, t) (see ``stirling_ratios``) times the
    product of the first factor over 1 ... t - 1 tables, and t is drawn from these weights themselves. With ``parent`` (mass, total) a customer that
    opens a table also sits down in the parent restaurant, which draws the next one there: a factor (mass + tables) / (total + tables).
    ``ratios`` is ``stirling_ratios`` up to ``EXACT`` customers, where it is known.
    """

    def opening(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        out = np.maximum(strength[rows] + per_table[rows] * tables, 1e-300)
        if parent:
            mass, total = parent
            out = out * np.maximum(mass[rows] + tables, 1e-300) / (total[rows] + tables)
        return out

    tables = np.minimum(customers, 1).astype(np.float64)
    exact = np.flatnonzero((customers > 1) & (customers <= EXACT))
    order = exact[np.argsort(customers[exact], kind="stable")]
    sizes, first = np.unique(customers[order], return_index=True)
    if ratios is None and len(sizes):
        ratios = stirling_ratios(discount, int(sizes[-1]))
    for c, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)][: len(sizes)], strict=True):
        j, step, ratio = np.arange(1, c), max(1, (1 << 18) // c), ratios_of(ratios, c)
        for low in range(a, b, step):
            part = order[low : min(b, low + step)]
            rates = opening(part[:, None], j) * ratio
            weight = np.ones((len(part), c))
            # Weights rise to one top and fall, so what gets too small to write down has no part in the draw.
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                np.cumprod(rates, axis=1, out=weight[:, 1:])
                beyond = np.flatnonzero(~np.isfinite(weight.sum(axis=1)))
            if len(beyond):
                gain = np.concatenate([np.zeros((len(beyond), 1)), np.cumsum(np.log(rates[beyond]), axis=1)], axis=1)
                weight[beyond] = np.exp(gain - gain.max(axis=1, keepdims=True))
            tables[part] = 1 + _drawn(weight, rng)
    far = np.flatnonzero(customers > EXACT)
    if len(far):
        tables[far] = _seat_many(customers[far].astype(np.float64), lambda rows, t: np.log(opening(far[rows], t)), discount, rng)
    return tables


def _drawn(weight: np.ndarray, rng) -> np.ndarray:
    """A column of each row, by its weights."""
    mass = np.cumsum(weight, axis=1)
    return np.minimum((mass < rng.random((len(mass), 1)) * mass[:, -1:]).sum(axis=1), weight.shape[1] - 1)


def _seat_many(c: np.ndarray, log_opening, discount: float, rng) -> np.ndarray:
    """The same for dishes of many customers: the mode by bisection, then a draw from 257 places around it, which reach eight deviations far."""
    each = np.arange(len(c))
    gain = lambda t: log_opening(each, t) + np.log(np.maximum(far_ratio(c, t, discount), 1e-300))
    low, high = np.ones(len(c)), c - 1
    for _ in range(64):
        middle = np.sqrt(low * high)
        up = gain(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    mode = np.maximum(1.0, np.round(low))
    ahead = np.minimum(mode * 1.05 + 1, c - 1)
    slope = (gain(mode) - gain(ahead)) / np.maximum(ahead - mode, 1e-9)
    stride = np.maximum(1.0, np.ceil(8 / np.sqrt(np.maximum(slope, 1e-12)) / 128))
    stride = np.minimum(stride, np.maximum(1.0, np.ceil(c / 257)))
    start = np.clip(mode - 128 * stride, 1, None)
    places = np.minimum(start[:, None] + stride[:, None] * np.arange(257), c[:, None])
    between = places[:, 1:] - places[:, :-1]
    rows, t = np.repeat(each, 256), np.maximum(((places[:, :-1] + places[:, 1:] - 1) / 2).ravel(), 1)
    rates = log_opening(rows, t) + np.log(np.maximum(far_ratio(c[rows], t, discount), 1e-300))
    weight = np.concatenate([np.zeros((len(c), 1)), np.cumsum(rates.reshape(len(c), 256) * between, axis=1)], axis=1)
    weight[:, 1:][between == 0] = -np.inf
    return places[each, _drawn(np.exp(weight - weight.max(axis=1, keepdims=True)), rng)]


class Seating:
    """Gibbs sweeps over one bucket's words: the tables of its pairs and, in the parent, of its words.

    A sweep takes the customers of one word out of one restaurant and seats them anew, given all else: the tables of all words, of
    other buckets too, as they were at the end of the sweep before. ``state`` is what a later task goes on from; samples that are kept are
    kept whole, with the totals that held then, so that probabilities can be averaged.
    """

    def __init__(self, row: dict, n_contexts: int, state: dict | None = None):
        per_word = unpacked(row["per_word"], np.int32)
        self.bucket, self.n_contexts, self.n_words = row["bucket"], n_contexts, len(per_word)
        self.word = np.repeat(np.arange(len(per_word)), per_word)
        self.context = unpacked(row["contexts"], np.int32).astype(np.int64)
        self.counts = unpacked(row["counts"], np.int64)
        self.many = np.flatnonzero(self.counts > 1)
        self.tables = np.minimum(self.counts, 1).astype(np.float64)
        self.kept: dict[str, np.ndarray] = {c: np.zeros(0, np.int64) for c in ("kept_pairs", "kept_parents", "kept_contexts", "kept_totals")}
        self.in_context = np.zeros(n_contexts)
        if state:
            self.tables[self.many] = unpacked(state["pair_tables"], np.int64)
            self.kept = {c: unpacked(state[c], np.int64) for c in self.kept}
            self.in_context = unpacked(state["in_context"], np.int64).astype(np.float64)
        self.parent_customers = np.bincount(self.word, self.tables, self.n_words)
        self.parent_tables = np.minimum(self.parent_customers, 1)
        if state:
            self.parent_tables = unpacked(state["parent_tables"], np.int64).astype(np.float64)

    def state(self) -> dict:
        columns = {"pair_tables": self.tables[self.many], "parent_tables": self.parent_tables, "in_context": self.in_context, **self.kept}
        return {name: packed(np.asarray(values).astype(np.int64)) for name, values in columns.items()}

    def of_context(self) -> np.ndarray:
        return np.bincount(self.context, self.tables, self.n_contexts)

    def keep(self, model: Model) -> None:
        """Keeps the sample there is; ``model`` has the totals over all buckets that belong to it."""
        found = {
            "kept_pairs": self.tables[self.many],
            "kept_parents": self.parent_tables,
            "kept_contexts": model.tables,
            "kept_totals": [model.parent_customers, model.parent_tables],
        }
        self.kept = {c: np.concatenate([self.kept[c], np.round(values).astype(np.int64)]) for c, values in found.items()}

    def sweep(self, number: int, model: Model, ratios: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``model`` has the totals over all buckets as they are now; ``ratios`` of its two discounts, where they are known."""
        d, d0, many = model.discount, model.parent_discount, self.many
        rng = np.random.default_rng([SEED, self.bucket, number])
        w, k, own = self.word[many], self.context[many], self.tables[many]
        rest = np.maximum(self.parent_customers[w] - own - d0 * np.minimum(self.parent_tables[w], self.parent_customers[w] - own), 0)
        mass = rest + (STRENGTH + d0 * model.parent_tables) * model.uniform
        others = STRENGTH + d * (model.tables[k] - own)
        self.tables[many] = seat(self.counts[many], others, np.full(len(many), d), d, rng, (mass, STRENGTH + model.parent_customers - own), ratios[0] if ratios else None)
        self.parent_customers = np.bincount(self.word, self.tables, self.n_words)
        elsewhere = model.parent_tables - self.parent_tables
        full = np.full(self.n_words, model.uniform)
        self.parent_tables = seat(self.parent_customers.astype(np.int64), (STRENGTH + d0 * elsewhere) * model.uniform, d0 * full, d0, rng, None, ratios[1] if ratios else None)

    def chances(self, model: Model) -> np.ndarray:
        """The probability of each pair's word in its context, averaged over the kept samples."""
        d, d0 = model.discount, model.parent_discount
        totals = self.kept["kept_totals"].reshape(-1, 2)
        n = len(totals)
        shares = [self.kept[c].reshape(n, -1).astype(np.float64) for c in ("kept_pairs", "kept_parents", "kept_contexts")]
        mean = np.zeros(len(self.counts))
        tables = np.minimum(self.counts, 1).astype(np.float64)
        for (customers0, tables0), pairs, parents, contexts in zip(totals.tolist(), *shares, strict=True):
            tables[self.many] = pairs
            seated = np.bincount(self.word, tables, self.n_words) - d0 * parents
            parent = (seated + (STRENGTH + d0 * tables0) * model.uniform) / (STRENGTH + customers0)
            escape = (STRENGTH + d * contexts[self.context]) * parent[self.word]
            mean += (self.counts - d * tables + escape) / (STRENGTH + self.in_context[self.context]) / n
        return mean

    def replies(self, row: dict, model: Model) -> Iterator[dict]:
        """What its chunks asked for: counts of words and probabilities of pairs."""
        chances = self.chances(model).astype(np.float32)
        word_counts = np.bincount(self.word, self.counts, self.n_words).astype(np.int64)
        word_cut = np.append(0, np.frombuffer(row["n_words"], np.int64).cumsum())
        pair_cut = np.append(0, np.frombuffer(row["n_pairs"], np.int64).cumsum())
        word_at, pair_at = unpacked(row["word_at"], np.int32), unpacked(row["pair_at"], np.int32)
        for j, chunk in enumerate(np.frombuffer(row["chunks"], np.int64).tolist()):
            words, pairs = word_at[word_cut[j] : word_cut[j + 1]].cumsum(), pair_at[pair_cut[j] : pair_cut[j + 1]].cumsum()
            yield {"chunk": chunk, "bucket": self.bucket, "word_counts": packed(word_counts[words]), "chances": packed(chances[pairs])}


def sampled(row: dict, model: Model, sweeps: int, burn_in: int) -> tuple[Seating, Model]:
    """All sweeps of the only bucket there is, whose own totals are those over all buckets."""
    seating, now = Seating(row, len(model.tables)), model
    seating.in_context = model.customers
    for number in range(sweeps):
        seating.sweep(number, now)
        now = replace(
            now,
            tables=seating.of_context(),
            parent_customers=float(seating.parent_customers.sum()),
            parent_tables=float(seating.parent_tables.sum()),
        )
        if number >= burn_in:
            seating.keep(now)
    return seating, now


def _schema(spec: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()),
        "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spec.split(", ")])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _written(df: DataFrame) -> DataFrame:
    """Written to the shared folder in small row groups, as a row holds megabytes."""
    path = scratch_path(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(df: DataFrame) -> None:
    """Deletes the files of a table that was written here and isn't read any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _by_group(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """A function of each group of ``key``, an int, from one Arrow table to another.

    It cogroups with no rows: every task of ``applyInArrow`` on the groups of one table leaves the buffers of its last batch, tens of KB a
    column, allocated in its executor for good (Spark 4.1), and a task of cogroups doesn't.
    """
    none = df.sparkSession.range(0).select(F.col("id").cast("int").alias(key))
    return df.groupBy(key).cogroup(none.groupBy(key)).applyInArrow(lambda rows, _: fn(rows), schema)


def _by_position(df: DataFrame) -> np.ndarray:
    """The element-wise sum of the column ``sums``; as many rows as elements come to the driver."""
    rows = df.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.k] = r.x
    return out


def lm_scores(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from all rows for which ``train`` holds (null: held out) and scores all. Null and empty texts are one token, the end, and are
    learnt from as such. Repeated rows count as often as they come; other columns are ignored; an empty table gives an empty
    table. Without training rows every token is unknown, and its probability is 1.
    """
    spark: SparkSession = docs.sparkSession
    chunk_schema, request_schema, bucket_schema, state_schema, reply_schema, asked_schema, place_schema, part_schema, score_schema = map(
        _schema, (CHUNKS, REQUESTS, BUCKETS, STATES, REPLIES, ASKED, PLACES, PARTS, SCORES)
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("t"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = ChunkBuilder(TaskContext.get().partitionId() << 32)
        for batch in pieces(batches):
            for doc_id, text, learn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                builder.add(doc_id, text, learn)
                if builder.bytes >= chunk_bytes:
                    yield _batch([builder.finish()], chunk_schema)
        if builder.docs:
            yield _batch([builder.finish()], chunk_schema)

    chunks = _written(rows.mapInArrow(cut, CHUNKS))
    n_buckets = max(1, min(MAX_BUCKETS, chunks.select("chunk").count()))
    model = Model(np.zeros(0, np.int64), n_buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = own_model(row, model)
                yield _batch([with_keys(r, own) for r in Chunk(row, own).requests(row["chunk"], own)], request_schema)

    def merge(group: pa.Table) -> pa.Table:
        requests = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        return pa.Table.from_batches([_batch([merge_by_keys(requests, n_buckets)], bucket_schema)])

    def ask_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = by_shard(unpacked(row["cut"], np.int32), np.frombuffer(row["keys"], np.int64), unpacked(row["customers"], np.int64))
                asked = [{"asker": row["bucket"], "shard": s, "keys": k.tobytes(), "customers": packed(c)} for s, k, c in parts]
                yield _batch(asked, asked_schema)

    def place(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(places_of_shard(sorted(group.to_pylist(), key=lambda r: r["asker"])), place_schema)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = by_shard(unpacked(row["cut"], np.int32), unpacked(row["tables"], np.int64))
                yield _batch([{"asker": row["bucket"], "shard": s, "tables": packed(t)} for s, t in parts], part_schema)

    def add(parts: pa.Table, places: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(add_shard(places.to_pylist()[0], parts.to_pylist()), part_schema)])

    own = chunks.drop("doc_ids", "n_docs")
    buckets = _written(_by_group(own.mapInArrow(ask, REQUESTS), "bucket", merge, BUCKETS))
    first = _by_position(buckets)
    if len(first):
        model.tokens, model.words = int(first[0]), int(first[1])
        once, twice, once0, twice0 = first[2:6]
        # Bounded away from 0 and 1, where a restaurant has no tables to add or no seats to share.
        model.discount = float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))
        model.parent_discount = float(np.clip(once0 / max(1, once0 + 2 * twice0), 0.05, 0.95))
        # One table per pair, so as many customers of the parent as words in contexts.
        model.parent_customers, model.parent_tables = float(first[6]), float(model.words)

    exact = min(EXACT, max(2, model.tokens))
    ratios = spark.sparkContext.broadcast((stirling_ratios(model.discount, exact), stirling_ratios(model.parent_discount, exact)))
    # Where contexts are in their shards, and the customers of contexts over all buckets, never change.
    shards = _written(_by_group(buckets.select("bucket", "cut", "keys", "customers").mapInArrow(ask_shards, ASKED), "shard", place, PLACES))
    places = shards.where("askers IS NOT NULL").select("shard", "askers", "sizes", "places")
    in_contexts = shards.where("asker IS NOT NULL").select(F.col("asker").alias("bucket"), "shard", "customers")

    def added_up(states: DataFrame) -> DataFrame:
        parts = states.select("bucket", "cut", "tables").mapInArrow(send, PARTS)
        return parts.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(add, PARTS)

    def seating_of(own: pa.Table, told: pa.Table, model: Model) -> tuple[dict, Seating, Model]:
        """A bucket, its seating after the last sweep, and the model with the totals that are then."""
        rows, answers = own.to_pylist(), told.to_pylist()
        row = next(r for r in rows if r["counts"] is not None)
        state = next((r for r in rows if r["pair_tables"] is not None), None)
        tables = from_shards(answers, "tables")
        seating = Seating(row, len(tables), state)
        if not state:
            seating.in_context = from_shards(answers, "customers")
        return row, seating, replace(model, tables=tables)

    def sweeper(number: int, model: Model):
        def sweep(own: pa.Table, told: pa.Table) -> pa.Table:
            row, seating, now = seating_of(own, told, model)
            if number > burn_in:
                seating.keep(now)
            seating.sweep(number, now, ratios.value)
            sums = [float(seating.parent_customers.sum()), float(seating.parent_tables.sum())]
            tables = packed(seating.of_context().astype(np.int64))
            state = {"bucket": row["bucket"], "cut": row["cut"], "tables": tables, "sums": sums, **seating.state()}
            return pa.Table.from_batches([_batch([state], state_schema)])

        return sweep

    def replier(model: Model):
        def reply(own: pa.Table, told: pa.Table) -> pa.Table:
            row, seating, now = seating_of(own, told, model)
            seating.keep(now)
            return pa.Table.from_batches([_batch(list(seating.replies(row, now)), reply_schema)])

        return reply

    # Each sweep starts from the totals over all buckets after the one before; after the last one, its totals go with it.
    to_sweep = ["bucket", "cut", "per_word", "contexts", "counts"]
    to_reply = [*to_sweep, "chunks", "n_words", "n_pairs", "word_at", "pair_at"]
    states = buckets.select("bucket", "cut", "tables")
    for number in range(sweeps + 1):
        is_last = number == sweeps
        told = added_up(states).withColumnRenamed("asker", "bucket")
        rows = buckets.select(to_reply if is_last else to_sweep)
        if number:
            rows = rows.unionByName(states.select("bucket", *SEATING), allowMissingColumns=True)
        else:
            rows = rows.withColumns({c: F.lit(None).cast("binary") for c in SEATING})
            told = told.unionByName(in_contexts, allowMissingColumns=True)
        groups = rows.groupBy("bucket").cogroup(told.groupBy("bucket"))
        if is_last:
            replies = _written(groups.applyInArrow(replier(model), REPLIES))
        else:
            before, states = states, _written(groups.applyInArrow(sweeper(number, model), STATES))
            if number:
                _drop(before)
            after = _by_position(states)
            if len(after):
                model = replace(model, parent_customers=float(after[0]), parent_tables=float(after[1]))
    _drop(shards)
    _drop(states)
    _drop(buckets)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, right = left.to_pylist()[0], right.to_pylist()
        mine = own_model(row, model)
        chunk = Chunk(row, mine)
        found = chunk.scores(sorted(right, key=lambda r: r["bucket"]), mine)
        ids = [int.from_bytes(row["doc_ids"][a + 1 : a + 9], "little", signed=True) if row["doc_ids"][a] else None for a in range(0, 9 * row["n_docs"], 9)]
        columns = {"doc_id": ids, "held_out": ~chunk.train, "n_tokens": chunk.lengths, "train_tokens": np.full(len(ids), mine.tokens), **found}
        return pa.table([pa.array(columns[f.name], f.type) for f in score_schema], schema=score_schema)

    answers = replies
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
