"""Per-key folds over one micro-batch, vectorized; used inside the stateful processors."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

from ..operators.chain import chain


def in_time_order(ts: np.ndarray) -> bool:
    return bool((ts[1:] >= ts[:-1]).all())


def fired_positions(
    ts: np.ndarray, opens: int, gap: int, forced: np.ndarray | None = None
) -> tuple[list[int], int]:
    """Positions that fire under a cooldown, and the earliest time the next row may fire. ``ts`` is in arrival order."""
    if in_time_order(ts):
        must = np.flatnonzero(forced) if forced is not None else np.empty(0, dtype="int64")
        fired, _, opens = chain(ts, ts + gap, must, opens)
        return fired, opens
    fired = []
    for i, t in enumerate(ts.tolist()):
        if t >= opens or forced is not None and forced[i]:
            fired.append(i)
            opens = t + gap
    return fired, opens


def arrival_counts(held: list[int], ts: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """The count after each arrival, and the times held after the last.

    Each row drops, from the oldest arrival on, what lies before its window; a time behind a younger arrival stays.
    """
    times, counts, first = [*held, *ts.tolist()], [], 0
    for i in range(len(held), len(times)):
        while times[first] < times[i] - window:
            first += 1
        counts.append(i - first + 1)
    return counts, times[first:]


def arrival_distinct(seen: dict[int, int], ts: np.ndarray, value: np.ndarray, window: int):
    """Per arrival, the values whose last arrival is in the window. ``seen``, the latest time by value, is kept up to date.

    Yields ``seen`` itself after each arrival. A value that has expired stays out, even for a row that is late.
    """
    order = sorted((t, v) for v, t in seen.items())
    for t, v in zip(ts.tolist(), value.tolist(), strict=True):
        if v in seen:
            del order[bisect_left(order, (seen[v], v))]
        seen[v] = t
        insort(order, (t, v))
        expired = bisect_left(order, (t - window,))
        for _, old in order[:expired]:
            del seen[old]
        del order[:expired]
        yield seen


def live_counts(ts: np.ndarray, window: int) -> np.ndarray:
    """For each row, the rows up to it that lie in ``[ts - window, ts]``."""
    return np.arange(1, len(ts) + 1) - np.searchsorted(ts, ts - window, side="left")


def live_distinct_counts(ts: np.ndarray, value: np.ndarray, window: int) -> np.ndarray:
    """For each row, the distinct values whose latest occurrence up to it lies in ``[ts - window, ts]``."""
    n = len(ts)
    grouped = np.lexsort((np.arange(n), value))
    same = value[grouped][1:] == value[grouped][:-1]
    apart = ts[grouped][1:] - ts[grouped][:-1] > window
    starts, ends = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    starts[grouped[1:]] = ~same | apart
    ends[grouped[:-1]] = ~same | apart
    expired = np.searchsorted(np.sort(ts[ends]), ts - window, side="left")
    return np.cumsum(starts) - expired
