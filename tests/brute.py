"""Definitions written out over plain lists, with no shared code: what the operators must equal.

Rows are dicts in arrival order. Quadratic on purpose.
"""

from __future__ import annotations

MICROS = 1_000_000

BASE = {
    "src_ip": "10.0.0.1",
    "dst_ip": "10.0.0.2",
    "src_mac": "aa:aa:aa:aa:aa:aa",
    "dst_mac": "bb:bb:bb:bb:bb:bb",
    "protocol": "TCP",
    "src_port": 12345,
    "dst_port": 80,
    "tcp_flags": "S",
    "is_arp": False,
    "arp_op": None,
    "length": 60,
}


def packet(ts, **changes):
    return {**BASE, "ts": float(ts), **changes}


def packets_df(spark, rows):
    from wiretide.schema import PACKET_FIELDS
    from wiretide.sources.packets import as_packets
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("seq", T.LongType()), *PACKET_FIELDS.fields])
    data = [tuple([i] + [row[f.name] for f in PACKET_FIELDS]) for i, row in enumerate(rows)]
    return as_packets(spark.createDataFrame(data, schema))


def windowed(rows, i, key, window):
    now = rows[i]["ts_us"]
    return [r for r in rows[: i + 1] if r[key] == rows[i][key] and now - window <= r["ts_us"]]


def count_in_window(rows, key, window):
    return [len(windowed(rows, i, key, window)) for i in range(len(rows))]


def distinct_in_window(rows, key, value, window):
    return [len({r[value] for r in windowed(rows, i, key, window)}) for i in range(len(rows))]


def distinct_so_far(rows, key, value):
    return [len({r[value] for r in rows[: i + 1] if r[key] == row[key]}) for i, row in enumerate(rows)]


def debounce(times, gap, forced=None):
    """Indexes that fire, for one key."""
    fired, last = [], None
    for i, t in enumerate(times):
        if (forced and forced[i]) or last is None or t - last >= gap:
            fired.append(i)
            last = t
    return fired


def window_starts(times, window):
    starts = []
    for t in times:
        if not starts or t - starts[-1] >= window:
            starts.append(t)
    return starts


def anomalies(rows, window, baseline, multiplier, min_samples):
    """``(close ts_us, close seq, n, average, top source, its count)`` per alert."""
    groups = []
    for r in rows:
        if not groups or r["ts_us"] - groups[-1][0]["ts_us"] >= window:
            groups.append([])
        groups[-1].append(r)
    out = []
    for i in range(len(groups) - 1):
        before = [len(g) for g in groups[max(0, i - baseline) : i]]
        n = len(groups[i])
        if len(before) < min_samples or not before or n <= multiplier * (sum(before) / len(before)):
            continue
        sources = [r["src_ip"] for r in groups[i] if r["src_ip"]]
        top = min(set(sources), key=lambda s: (-sources.count(s), sources.index(s))) if sources else "unknown"
        closing = groups[i + 1][0]
        out.append((closing["ts_us"], closing["seq"], n, sum(before) / len(before), top, sources.count(top)))
    return out
