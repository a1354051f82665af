"""A suffix tree of a sequence of numbers, built by Ukkonen's algorithm, with constant-time longest common extensions.

The string depths along the tree's Euler tour are kept with their minima, so that the depth of the lowest common ancestor of two
leaves, which is the length of what two suffixes share, is three lookups. All memory is linear in the sequence.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32
_FAR = 1 << 60


class SuffixTree:
    """Of symbols 1, 2, 3...; the end is symbol 0."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.text = [*symbols, 0]
        self.base = max(self.text) + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, base = self.text, self.base
        start, end, link, leaf_of = [0], [0], [0], []
        child: dict[int, int] = {}
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key)
                if below is None:
                    leaf_of.append(len(start))
                    child[key] = len(start)
                    start.append(i)
                    end.append(_FAR)
                    link.append(0)
                    if made:
                        link[made] = node
                    made = 0
                else:
                    first = start[below]
                    size = min(end[below], i + 1) - first
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if text[first + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    fork = len(start)
                    child[key] = fork
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    leaf_of.append(fork + 1)
                    start.append(i)
                    end.append(_FAR)
                    link.append(0)
                    start[below] = first + length
                    child[fork * base + c] = fork + 1
                    child[fork * base + text[first + length]] = below
                    if made:
                        link[made] = fork
                    made = fork
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.child, self.leaf_of = start, end, child, leaf_of

    def _tour(self) -> None:
        """The Euler tour, children in ascending order of symbols; leaves come in the order of their suffixes."""
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        below = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)
        kids = below[order].tolist()
        nodes = len(self.start)
        stops = np.searchsorted(keys[order], (np.arange(nodes) + 1) * self.base).tolist()
        upto = [0, *stops[:-1]]
        sizes = (np.minimum(np.array(self.end), len(self.text)) - np.array(self.start)).tolist()
        above, depth, first = [0] * nodes, [0] * nodes, [0] * nodes
        tour = [0]
        node = 0
        while True:
            at = upto[node]
            if at < stops[node]:
                upto[node] = at + 1
                kid = kids[at]
                above[kid] = node
                depth[kid] = depth[node] + sizes[kid]
                node = kid
                first[node] = len(tour)
            elif node:
                node = above[node]
            else:
                break
            tour.append(depth[node])
        self.first = np.array(first)[np.array(self.leaf_of)]
        self.child = {}
        self._minima(np.array(tour, np.int32))

    def _minima(self, tour: np.ndarray) -> None:
        blocks = -(-len(tour) // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = tour
        grid = padded.reshape(blocks, _BLOCK)
        self.tour = padded
        self.from_left = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        levels = [grid.min(axis=1)]
        while 2 << len(levels) - 1 <= blocks:
            half = 1 << len(levels) - 1
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        self.levels = levels

    def ranks(self) -> np.ndarray:
        """For each suffix but the empty one, its place in the ascending order of suffixes; a suffix follows its beginnings."""
        out = np.empty(self.n + 1, np.int64)
        out[np.argsort(self.first)] = np.arange(self.n + 1)
        return out[: self.n]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of what the suffixes at ``i`` and ``j`` (not equal, up to n) begin with in common."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.from_right[a], self.from_left[b])
        same = np.flatnonzero(low == high)
        if len(same):
            reach = np.minimum(a[same, None] + np.arange(_BLOCK), b[same, None])
            out[same] = self.tour[reach].min(axis=1)
        gap = high - low - 1
        level = np.frexp(np.maximum(gap, 1))[1] - 1
        for k in np.unique(level[gap > 0]):
            rows = np.flatnonzero((gap > 0) & (level == k))
            span = self.levels[k]
            out[rows] = np.minimum(out[rows], np.minimum(span[low[rows] + 1], span[high[rows] - (1 << int(k))]))
        return out.astype(np.int64)
