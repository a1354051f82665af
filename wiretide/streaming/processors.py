"""Keyed streaming detectors on ``transformWithStateInPandas``.

Each source keeps only what its window still needs. Without a watermark, rows count when they arrive, in the order of their arrival
numbers. With one, rows are held back until the watermark has passed them and then folded in the order of time, so the
alerts are those of the batch operators on the rows that weren't too late.

A group of the stateful operator costs milliseconds, whatever its rows, so groups are buckets of sources and a source is an entry of its
bucket's map, which is read and written only when the source has rows. A bucket's held rows are kept in packs.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import arrival_counts, arrival_distinct, fired_positions, in_time_order, live_counts, live_distinct_counts

_NEVER = -(2**62)
# Alerts handed over at a time, and held rows in one pack.
_PACK = 10_000

FIRED_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("observed", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _fired(source: list[str], ts_us: list[int], seq: list[int], observed: list[int], items: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "src_ip": source,
            "ts_us": np.asarray(ts_us, dtype="int64"),
            "seq": np.asarray(seq, dtype="int64"),
            "observed": np.asarray(observed, dtype="int64"),
            "items": items,
        }
    )


class Kept:
    """A value of one source, with the calls of a state handle."""

    def __init__(self, value: tuple | None) -> None:
        self.value, self.changed = value, False

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value, self.changed = value, True


class KeptMap:
    """Values by key of one source, with the calls of a state handle; ``now`` is noted for each key that is written."""

    def __init__(self, keys: list[str], noted: list[int], now: int) -> None:
        self.noted, self.now, self.changed = dict(zip(keys, noted, strict=True)), now, False

    def keys(self) -> list[tuple]:
        return [(k,) for k in self.noted]

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.noted[key[0]] = self.now
        self.changed = True


class PerSourceProcessor(StatefulProcessor):
    """Brings the rows of a bucket's sources into order for ``found``, source by source. ``value`` names the column that is counted.

    ``state_type`` is what is kept of a source; ``load`` and ``saved`` bring it into the handles that ``found`` uses and back.
    """

    value: str | None = None
    state_type: str
    event_time = False
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", "src_ip string", self.state_type, self.ttl_ms)
        if self.event_time:
            packs = "src_ip array<string>, ts_us array<bigint>, seq array<bigint>, value array<string>"
            self.held = handle.getListState("held", packs)

    def load(self, value: tuple | None, now: int) -> None:
        self.state = Kept(value)

    def saved(self) -> tuple | None:
        """What is to be written; None if nothing has changed."""
        return self.state.get() if self.state.changed else None

    def found(self, ts: np.ndarray, value: np.ndarray | None) -> tuple[list[int], list[int], list]:
        """Of a source's rows in their order: the places of those that fire, their ``observed`` and ``items``."""
        raise NotImplementedError

    def fold(self, source: str, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What fires of one source's rows, which come in their order."""
        ts, seq = batch["ts_us"].to_numpy(), batch["seq"].to_numpy()
        at, observed, items = self.found(ts, batch[self.value].to_numpy() if self.value else None)
        if at:
            yield _fired([source] * len(at), ts[at], seq[at], observed, items)

    def _fold_sources(self, rows: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """Rows of several sources, each source's in their order."""
        codes, names = pd.factorize(rows["src_ip"])
        order = np.argsort(codes, kind="stable")
        ts, seq = rows["ts_us"].to_numpy()[order], rows["seq"].to_numpy()[order]
        value = rows[self.value].to_numpy()[order] if self.value else None
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        known = self.sources.exists()
        columns: tuple[list, ...] = ([], [], [], [], [])
        first = 0
        for name, end in zip(names, ends, strict=True):
            kept = self.sources.getValue((name,)) if known else None
            self.load(None if kept is None else tuple(kept), now)
            at, observed, items = self.found(ts[first:end], None if value is None else value[first:end])
            saved = self.saved()
            if saved is not None:
                self.sources.updateValue((name,), saved)
            if at:
                places = np.asarray(at) + first
                parts = ([name] * len(at), ts[places].tolist(), seq[places].tolist(), observed, items)
                for column, part in zip(columns, parts, strict=True):
                    column.extend(part)
            if len(columns[0]) >= _PACK:
                yield _fired(*columns)
                columns = ([], [], [], [], [])
            first = end
        if columns[0]:
            yield _fired(*columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
            yield from self._fold_sources(batch.sort_values("seq", kind="stable", ignore_index=True), now)
            return
        values = batch[self.value].astype(str) if self.value else pd.Series([None] * len(batch), dtype=object)
        self._hold(*[c.tolist() for c in (batch["src_ip"], batch["ts_us"], batch["seq"], values)])
        self._wake(batch["ts_us"].min())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packs = list(self.held.get()) if self.held.exists() else []
        columns = [[x for pack in packs for x in pack[k]] for k in range(4)]
        held = pd.DataFrame(dict(zip(["src_ip", "ts_us", "seq", self.value or "value"], columns, strict=True)))
        due = held[held["ts_us"] < passed] if len(held) else held
        if not len(due):
            return  # another timer of this bucket has taken them
        rest = held[held["ts_us"] >= passed]
        self.held.clear()
        if len(rest):
            self._hold(*[rest[c].tolist() for c in rest.columns])
            self._wake(rest["ts_us"].min())
        yield from self._fold_sources(due.sort_values(["ts_us", "seq"], kind="stable", ignore_index=True), 0)

    def _hold(self, *columns: list) -> None:
        n = len(columns[0])
        self.held.appendList([tuple(c[a : a + _PACK] for c in columns) for a in range(0, n, _PACK)])

    def _wake(self, ts_us: int) -> None:
        """A timer for when the watermark has passed this time."""
        self.handle.registerTimer(int(ts_us) // 1000 + 1)

    def close(self) -> None:
        pass


class SynFloodProcessor(PerSourceProcessor):
    """State: the times still in the window and the end of the cooldown."""

    state_type = "times array<bigint>, opens bigint"

    def __init__(self, threshold: int, window: int, gap: int) -> None:
        self.threshold, self.window, self.gap = threshold, window, gap

    def found(self, ts: np.ndarray, value: np.ndarray | None) -> tuple[list[int], list[int], list]:
        times, opens = self.state.get() if self.state.exists() else ([], _NEVER)
        new, ts = ts, np.concatenate([np.asarray(times, dtype="int64"), ts])
        if in_time_order(ts):
            observed = live_counts(ts, self.window)[len(times) :]
            times = ts[ts >= ts[-1] - self.window].tolist()
        else:
            observed, times = arrival_counts(times, new, self.window)
            observed = np.asarray(observed)
        over = np.flatnonzero(observed >= self.threshold)
        hits, opens = fired_positions(new[over], opens, self.gap)
        self.state.update((times, opens))
        at = over[hits].tolist()
        return at, observed[at].tolist(), [None] * len(at)


class PortScanProcessor(PerSourceProcessor):
    """State: the live ports with their latest time, and the end of the cooldown."""

    value = "dst_port"
    state_type = "ports array<int>, seen array<bigint>, opens bigint"

    def __init__(self, threshold: int, window: int, gap: int) -> None:
        self.threshold, self.window, self.gap = threshold, window, gap

    def found(self, ts: np.ndarray, value: np.ndarray | None) -> tuple[list[int], list[int], list]:
        ports, seen, opens = self.state.get() if self.state.exists() else ([], [], _NEVER)
        new, new_port = ts, value.astype("int64")
        ts = np.concatenate([np.asarray(seen, dtype="int64"), new])
        if in_time_order(ts):
            port = np.concatenate([np.asarray(ports, dtype="int64"), new_port])
            at, observed, items, opens = self._in_order(ts, port, len(ports), opens)
            # The last time of each port, as times ascend.
            inside = ts >= ts[-1] - self.window
            latest = dict(zip(port[inside].tolist(), ts[inside].tolist(), strict=True))
        else:
            latest = dict(zip(ports, seen, strict=True))
            at, observed, items = [], [], []
            for i, live in enumerate(arrival_distinct(latest, new, new_port, self.window)):
                if len(live) >= self.threshold and new[i] >= opens:
                    at.append(i)
                    observed.append(len(live))
                    items.append([str(p) for p in sorted(live)])
                    opens = int(new[i]) + self.gap
        latest = sorted(latest.items(), key=lambda x: x[1])
        self.state.update(([int(p) for p, _ in latest], [int(t) for _, t in latest], opens))
        return at, observed, items

    def _in_order(self, ts: np.ndarray, port: np.ndarray, old: int, opens: int):
        observed = live_distinct_counts(ts, port, self.window)[old:]
        over = np.flatnonzero(observed >= self.threshold)
        hits, opens = fired_positions(ts[old:][over], opens, self.gap)
        at = over[hits].tolist()
        items = []
        for i in at:
            first = int(np.searchsorted(ts, ts[old + i] - self.window, side="left"))
            items.append([str(p) for p in np.unique(port[first : old + i + 1])])
        return at, observed[at].tolist(), items, opens


class ArpSpoofProcessor(PerSourceProcessor):
    """State: the MACs bound to the address and the end of the cooldown.

    With ``ttl_ms`` a MAC is forgotten that long after it was bound; the count is always that of the MACs that are left.
    """

    value = "src_mac"
    state_type = "macs array<string>, bound_ms array<bigint>, opens bigint, opened_ms bigint"

    def __init__(self, gap: int, ttl_ms: int | None = None) -> None:
        self.gap, self.ttl_ms = gap, ttl_ms

    def load(self, value: tuple | None, now: int) -> None:
        macs, bound, opens, self.opened = value or ([], [], None, 0)
        if self.ttl_ms is not None:
            left = [k for k, at in enumerate(bound) if at + self.ttl_ms > now]
            macs, bound = [macs[k] for k in left], [bound[k] for k in left]
            opens = opens if self.opened + self.ttl_ms > now else None
        self.macs, self.state = KeptMap(macs, bound, now), Kept(None if opens is None else (opens,))

    def saved(self) -> tuple | None:
        if not (self.macs.changed or self.state.changed):
            return None
        opens = self.state.get()[0] if self.state.exists() else None
        opened = self.macs.now if self.state.changed else self.opened
        return list(self.macs.noted), list(self.macs.noted.values()), opens, opened

    def found(self, ts: np.ndarray, value: np.ndarray | None) -> tuple[list[int], list[int], list]:
        opens = self.state.get()[0] if self.state.exists() else _NEVER
        known = {m for (m,) in self.macs.keys()}
        listed = sorted(known)
        at, observed, items = [], [], []
        for i, (t, mac) in enumerate(zip(ts.tolist(), value.tolist(), strict=True)):
            new = mac not in known
            if new:
                known.add(mac)
                insort(listed, mac)
                self.macs.updateValue((mac,), (t,))
            if len(listed) >= 2 and (new or t >= opens):
                at.append(i)
                observed.append(len(listed))
                items.append(listed.copy())
                opens = t + self.gap
        if at:
            self.state.update((opens,))
        return at, observed, items
