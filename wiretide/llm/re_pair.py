"""Re-Pair grammar compression of one shard of token ids, and decoding of any stretch of it.

Frequent pairs of neighbouring symbols are replaced by new symbols, round after round. A round counts all pairs and takes those that
come at least a ``SPREAD``-th as often as the most frequent one, in falling order of counts, as long as no symbol is the
left part of one pair and the right part of another. Such pairs share no place, so replacing them together is replacing
them one by one. It ends when no pair comes ``LEAST`` times. A pair of older symbols never comes more often than before, so a round
looks only at the places of pairs that came ``LEAST`` times in the last one and beside the symbols that it made.

A symbol below the number of terminals stands for one id; symbol ``terminals + r`` stands for the two symbols of rule ``r``. Expansion
lengths of rules let a stretch be decoded without what lies before or after it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

LEAST = 8
SPREAD = 8
#: Slots by which places of rare pairs are told; one that shares its slot with a frequent pair is only looked at again.
SLOT_BITS = 18
#: Compressed symbols between two stored offsets.
STEP = 256
_HEAD = "<4sBxxxIIQQQ"
_MAGIC = b"RPS1"


@dataclass
class Grammar:
    terminals: np.ndarray  # uint32: the id of each terminal symbol
    rules: np.ndarray  # int64 (r, 2): the symbols of each rule, in the order in which they were made
    symbols: np.ndarray  # int64: the compressed sequence
    lengths: np.ndarray  # int64 (r,): ids of each rule's expansion


def compress(ids: np.ndarray, least: int = LEAST) -> Grammar:
    ids = np.asarray(ids, np.uint32)
    if len(ids) and ids.max() < 1 << 20:
        number = np.zeros(int(ids.max()) + 1, np.uint32)
        number[ids] = 1
        terminals = np.flatnonzero(number).astype(np.uint32)
        number[terminals] = np.arange(len(terminals))
        symbols = number[ids]
    else:
        terminals, symbols = np.unique(ids, return_inverse=True)
        symbols = symbols.astype(np.uint32)
    rules: list[np.ndarray] = []
    n = len(terminals)
    live = np.ones(len(symbols), bool)
    while len(symbols) > 1:
        chosen = frequent_pairs(symbols, n, least, live)
        if not len(chosen):
            break
        symbols = replace(symbols, chosen, n, live)
        live = live[: len(symbols)]
        rules.append(np.stack([chosen // n, chosen % n], axis=1))
        n += len(chosen)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return Grammar(terminals, made, symbols, rule_lengths(len(terminals), made))


def frequent_pairs(symbols: np.ndarray, n: int, least: int, live: np.ndarray | None = None) -> np.ndarray:
    """The pairs of a round as left * n + right, most frequent first; empty when no pair comes ``least`` times.

    ``live`` marks the places, by their left symbol, of all pairs that come ``least`` times, and others; most of the others are unmarked.
    """
    at = np.arange(len(symbols) - 1) if live is None else np.flatnonzero(live[:-1])
    left, right = symbols.take(at), symbols.take(at + 1)
    keys = pair_keys(left, right, n)
    ordered = np.sort(keys)
    # The first place of each key that is the same ``least`` - 1 places on.
    often = ordered[least - 1 :] == ordered[: max(0, len(keys) - least + 1)]
    often[1:] &= ordered[1 : len(often)] != ordered[: max(0, len(often) - 1)]
    starts = np.flatnonzero(often)
    if not len(starts):
        return np.zeros(0, np.int64)
    pairs = ordered[starts]
    counts = np.searchsorted(ordered, pairs, side="right") - starts
    if live is not None:
        seen = np.zeros(1 << SLOT_BITS, bool)
        seen[_slots(pairs)] = True
        live[at] = seen.take(_slots(keys))
    pairs = pairs.astype(np.int64)
    # A stretch of one symbol holds half as many pairs of it that don't overlap.
    double = np.flatnonzero(pairs % (n + 1) == 0)
    if len(double):
        apart = np.bincount(symbols[_every_second(at[left == right])], minlength=n)
        counts[double] = apart[pairs[double] // (n + 1)]
    level = max(least, int(counts.max()) // SPREAD)
    enough = np.flatnonzero(counts >= level)
    pairs = pairs[enough][np.lexsort((pairs[enough], -counts[enough]))]
    chosen, role = [], {}
    for pair, left, right in zip(pairs.tolist(), (pairs // n).tolist(), (pairs % n).tolist(), strict=True):
        if left == right:
            if left not in role:
                role[left] = "both"
                chosen.append(pair)
        elif role.get(left, "left") == "left" and role.get(right, "right") == "right":
            role[left], role[right] = "left", "right"
            chosen.append(pair)
    return np.array(chosen, np.int64)


def pair_keys(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """left * n + right, in 32 bits where they fit, which sort twice as fast."""
    kind = np.uint32 if n * n <= 1 << 32 else np.uint64
    return left.astype(kind, copy=False) * kind(n) + right.astype(kind, copy=False)


def _slots(keys: np.ndarray) -> np.ndarray:
    odd = 0x9E3779B1 if keys.dtype == np.uint32 else 0x9E3779B97F4A7C15
    return keys * keys.dtype.type(odd) >> keys.dtype.type(8 * keys.dtype.itemsize - SLOT_BITS)


def _every_second(at: np.ndarray) -> np.ndarray:
    """From ascending positions, the first, third, fifth... of each stretch of successive ones."""
    if not len(at):
        return at
    new = np.concatenate([[True], at[1:] != at[:-1] + 1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def replace(symbols: np.ndarray, chosen: np.ndarray, n: int, live: np.ndarray | None = None) -> np.ndarray:
    """The sequence with every place of pair ``chosen[r]`` replaced by symbol ``n + r``.

    ``live`` marks places that hold those of the chosen pairs; its start becomes the marks for the new sequence.
    """
    at = np.arange(len(symbols) - 1) if live is None else np.flatnonzero(live[:-1])
    keys = pair_keys(symbols.take(at), symbols.take(at + 1), n)
    wanted = chosen.astype(keys.dtype)
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[_slots(wanted)] = np.arange(len(chosen))
    rule = table.take(_slots(keys))
    near = np.flatnonzero(rule >= 0)
    at, keys, rule = at.take(near), keys.take(near), rule.take(near)
    # A slot holds one of its pairs only.
    other = np.flatnonzero(wanted.take(rule) != keys)
    order = np.argsort(chosen)
    rule[other] = order[np.minimum(np.searchsorted(wanted[order], keys[other]), len(chosen) - 1)]
    hit = np.flatnonzero(wanted.take(rule) == keys)
    at, rule = at.take(hit), rule.take(hit)
    # Only pairs of one symbol overlap, and only with themselves.
    kept = _every_second(at)
    rule = rule[np.searchsorted(at, kept)] if len(kept) < len(at) else rule
    made = kept - np.arange(len(kept))
    if live is not None:
        live[: len(symbols) - len(kept)] = np.delete(live, kept + 1)
    out = np.delete(symbols, kept + 1)
    out[made] = n + rule
    if live is not None:
        live[made] = live[np.maximum(made - 1, 0)] = True
    return out


def rule_lengths(n_terminals: int, rules: np.ndarray) -> np.ndarray:
    """Ids of each rule's expansion. A rule's parts are made in earlier rounds, so a few passes over all rules settle them."""
    lengths = np.ones(n_terminals + len(rules), np.int64)
    while len(rules):
        sums = lengths[rules[:, 0]] + lengths[rules[:, 1]]
        if (sums == lengths[n_terminals:]).all():
            break
        lengths[n_terminals:] = sums
    return lengths[n_terminals:]


def expand(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids of a sequence of symbols. Each different symbol is expanded once."""
    length = np.concatenate([np.ones(len(grammar.terminals), np.int64), grammar.lengths])
    used = np.zeros(len(length), bool)
    used[symbols] = True
    different = np.flatnonzero(used)
    ids = expand_each(grammar, different, length)
    sizes = length[different]
    place = np.empty(len(length), np.int64)
    place[different] = np.cumsum(sizes) - sizes
    sizes = length.take(symbols)
    ends = np.cumsum(sizes)
    at = np.repeat(place.take(symbols) - (ends - sizes), sizes)
    at += np.arange(len(at))
    return ids.take(at)


def expand_each(grammar: Grammar, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids of symbols, one after the other. Each pass splits every rule once, so it takes as many passes as the grammar is deep."""
    n = len(grammar.terminals)
    sizes = length[symbols]
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    while len(symbols):
        plain = symbols < n
        out[at[plain]] = grammar.terminals[symbols[plain]]
        at, symbols = at[~plain], symbols[~plain]
        parts = grammar.rules[symbols - n]
        at = np.concatenate([at, at + length[parts[:, 0]]])
        symbols = np.concatenate([parts[:, 0], parts[:, 1]])
    return out


def _bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of ``width`` bits each, lowest bit first. Every 64 values fill ``width`` words of 64 bits."""
    padded = np.zeros((-(-len(values) // 64), 64), np.uint64)
    padded.reshape(-1)[: len(values)] = values
    columns = np.ascontiguousarray(padded.T)
    words = np.zeros((width, len(padded)), np.uint64)
    for k, column in enumerate(columns):
        word, shift = divmod(k * width, 64)
        words[word] |= column << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()[: (len(values) * width + 7) // 8]


def _from_bits(data: memoryview, first: int, count: int, width: int) -> np.ndarray:
    """``count`` values from number ``first`` on, a multiple of 64."""
    rows = -(-count // 64)
    raw = bytes(data[first * width // 8 : ((first + count) * width + 7) // 8])
    words = np.ascontiguousarray(np.frombuffer(raw.ljust(8 * width * rows, b"\0"), "<u8").reshape(rows, width).T)
    columns = np.empty((64, rows), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        column = words[word] >> np.uint64(shift)
        if shift + width > 64:
            column |= words[word + 1] << np.uint64(64 - shift)
        columns[k] = column & mask
    return columns.T.reshape(-1)[:count].astype(np.int64)


def write_shard(ids: np.ndarray, doc_ids: list[int | None], doc_lengths: list[int], least: int = LEAST) -> bytes:
    """One shard as bytes.

    Layout, little-endian: magic, width of a symbol in bits, numbers of terminals, rules, symbols, ids and documents; terminals and
    expansion lengths as 32-bit numbers; the offset of every ``STEP``-th symbol; rules and symbols in ``width`` bits each; document
    ids (64 bits), whether each is known (8 bits) and its number of ids (32 bits).
    """
    g = compress(ids, least)
    width = max(1, int(len(g.terminals) + len(g.rules) - 1).bit_length())
    sizes = np.concatenate([np.ones(len(g.terminals), np.int64), g.lengths])[g.symbols]
    offsets = (np.cumsum(sizes) - sizes)[::STEP]
    parts = [
        struct.pack(_HEAD, _MAGIC, width, len(g.terminals), len(g.rules), len(g.symbols), len(ids), len(doc_ids)),
        g.terminals.astype("<u4").tobytes(),
        g.lengths.astype("<u4").tobytes(),
        offsets.astype("<u4").tobytes(),
        _bits(g.rules.reshape(-1), width),
        _bits(g.symbols, width),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array(doc_lengths, "<u4").tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """A shard's bytes, opened: its documents, and the ids of any stretch."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, n_terminals, n_rules, self.n_symbols, self.n_ids, n_docs = struct.unpack_from(_HEAD, view)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        terminals = np.frombuffer(take(4 * n_terminals), "<u4")
        lengths = np.frombuffer(take(4 * n_rules), "<u4").astype(np.int64)
        self.offsets = np.frombuffer(take(4 * -(-self.n_symbols // STEP)), "<u4")
        rules = _from_bits(take((2 * n_rules * self.width + 7) // 8), 0, 2 * n_rules, self.width).reshape(-1, 2)
        self.packed = take((self.n_symbols * self.width + 7) // 8)
        doc_ids, known = np.frombuffer(take(8 * n_docs), "<i8").tolist(), take(n_docs)
        self.doc_ids = [d if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.doc_lengths = np.frombuffer(take(4 * n_docs), "<u4").astype(np.int64)
        self.doc_starts = np.cumsum(self.doc_lengths) - self.doc_lengths
        self.grammar = Grammar(terminals, rules, np.zeros(0, np.int64), lengths)

    def ids(self, start: int = 0, length: int | None = None) -> np.ndarray:
        """The ids from ``start`` on. Only the symbols from the stored offset before it are read and expanded."""
        end = self.n_ids if length is None else min(self.n_ids, start + length)
        if start >= end:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.offsets, start, side="right") - 1)
        last = int(np.searchsorted(self.offsets, end, side="left"))
        stop = min(self.n_symbols, last * STEP)
        symbols = _from_bits(self.packed, first * STEP, stop - first * STEP, self.width)
        base = int(self.offsets[first])
        n = len(self.grammar.terminals)
        sizes = np.concatenate([np.ones(n, np.int64), self.grammar.lengths])[symbols]
        ends = base + np.cumsum(sizes)
        low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
        found = expand(self.grammar, symbols[low:high])
        skip = start - int(ends[low] - sizes[low])
        return found[skip : skip + end - start]
