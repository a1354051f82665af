"""Scenarios with exact alerts, and random streams against the written-out definitions."""

from __future__ import annotations

import random

import brute
import pytest
from brute import packet, packets_df

from wiretide.operators.detectors import (
    detect_arp_spoof,
    detect_port_scan,
    detect_syn_flood,
    detect_traffic_anomaly,
)

MICROS = 1_000_000


def alerts(df):
    return [(r.ts_us / MICROS, r.source_ip, r.observed, r.details) for r in df.orderBy("seq").collect()]


def times(df):
    return [a[0] for a in alerts(df)]


def ports(count, start=1000.0, step=0.1, first=1000, **changes):
    return [packet(start + step * i, dst_port=first + i, **changes) for i in range(count)]


def test_port_scan_below_and_at_threshold(spark):
    assert alerts(detect_port_scan(packets_df(spark, ports(10)))) == []
    [(ts, source, n, details)] = alerts(detect_port_scan(packets_df(spark, ports(20))))
    listed = ", ".join(str(p) for p in range(1000, 1015))
    assert (ts, source, n) == (1001.4, "10.0.0.1", 15)
    assert details == f"15 distinct ports contacted within 10s (threshold: 15); recent ports: [{listed}]"


def test_port_scan_cooldown_expiry_protocol_and_source(spark):
    rows = [packet(100 + p, dst_port=p) for p in range(5)]
    rows += [packet(110 + p, dst_port=p) for p in range(5, 10)]
    rows += [packet(200 + p, dst_port=p) for p in range(10, 15)]
    got = alerts(detect_port_scan(packets_df(spark, rows), 5, 10, 30))
    assert [(a[0], a[2]) for a in got] == [(104.0, 5), (214.0, 5)]

    rows = [packet(t, dst_port=p) for p, t in [(1, 0), (2, 0.5), (3, 20), (4, 21), (5, 22)]]
    assert alerts(detect_port_scan(packets_df(spark, rows), 5, 5, 30)) == []
    rows = [packet(i, dst_port=i, protocol="ARP") for i in range(5)]
    assert alerts(detect_port_scan(packets_df(spark, rows), 2, 10, 30)) == []
    rows = [packet(i, dst_port=i, src_ip=s) for i in range(2) for s in ("10.0.0.1", "10.0.0.2")]
    assert alerts(detect_port_scan(packets_df(spark, rows), 3, 10, 30)) == []


def test_port_scan_details(spark):
    # One port over TCP and UDP and on two hosts counts once; port 0 counts; a NULL port and an empty source do not.
    rows = [
        packet(1, dst_port=0),
        packet(2, dst_port=7),
        packet(2, dst_port=7, protocol="UDP", dst_ip="10.0.0.9"),
        packet(3, dst_port=None),
        packet(3, dst_port=8, src_ip=""),
        packet(3, dst_port=8, src_ip=None),
        packet(4, dst_port=9),
    ]
    [(ts, _, n, details)] = alerts(detect_port_scan(packets_df(spark, rows), 3, 10, 30))
    assert (ts, n) == (4.0, 3) and details.endswith("recent ports: [0, 7, 9]")
    # The 20 smallest live ports are listed, whatever their order of arrival.
    rows = [packet(i * 0.1, dst_port=100 - i) for i in range(25)]
    [(_, _, n, details)] = alerts(detect_port_scan(packets_df(spark, rows), 25, 10, 30))
    assert n == 25 and details.endswith(f"[{', '.join(str(p) for p in range(76, 96))}]")


def test_equal_times_reach_threshold_in_arrival_order(spark):
    rows = [packet(5, dst_port=p) for p in range(6)]
    [(_, _, n, _)] = alerts(detect_port_scan(packets_df(spark, rows), 3, 10, 30))
    assert n == 3
    [row] = detect_syn_flood(packets_df(spark, rows), 4, 5, 30).collect()
    assert (row.observed, row.seq) == (4, 3)


def test_counts_go_on_after_the_cooldown(spark):
    rows = [packet(i, dst_port=i) for i in range(40)]
    got = alerts(detect_port_scan(packets_df(spark, rows), 5, 100, 30))
    assert [(a[0], a[2]) for a in got] == [(4.0, 5), (34.0, 35)]


AA, BB, CC, FF = (":".join([c * 2] * 6) for c in "abcf")


def arp(ts, mac, ip="192.168.1.10", **changes):
    return packet(ts, **{"src_ip": ip, "src_mac": mac, "protocol": "ARP", "is_arp": True, "arp_op": 2, **changes})


def test_arp_spoof(spark):
    assert alerts(detect_arp_spoof(packets_df(spark, [arp(i, AA) for i in range(5)]))) == []
    got = alerts(detect_arp_spoof(packets_df(spark, [arp(1, AA), arp(2, FF)])))
    details = f"IP 192.168.1.10 is associated with 2 MAC addresses: ['{AA}', '{FF}']"
    assert got == [(2.0, "192.168.1.10", 2, details)]
    assert alerts(detect_arp_spoof(packets_df(spark, [arp(1, AA, is_arp=False), arp(2, FF, is_arp=False)]))) == []
    assert alerts(detect_arp_spoof(packets_df(spark, [arp(1, AA, "0.0.0.0"), arp(2, FF, "0.0.0.0")]))) == []
    assert times(detect_arp_spoof(packets_df(spark, [arp(1, AA), arp(2, BB), arp(5, BB)]))) == [2.0]
    # The flag decides, not the protocol; an empty MAC is no binding.
    assert times(detect_arp_spoof(packets_df(spark, [arp(1, AA, protocol="TCP"), arp(2, ""), arp(3, BB)]))) == [3.0]


def test_arp_new_mac_bypasses_and_resets_the_cooldown(spark):
    rows = [arp(1, AA), arp(2, BB), arp(30, CC), arp(62, AA), arp(89.999999, BB), arp(90, AA), arp(151, AA)]
    got = alerts(detect_arp_spoof(packets_df(spark, rows)))
    assert [(a[0], a[2]) for a in got] == [(2.0, 2), (30.0, 3), (90.0, 3), (151.0, 3)]


def syns(count, start, step, **changes):
    return [packet(start + step * i, **changes) for i in range(count)]


def test_syn_flood(spark):
    assert alerts(detect_syn_flood(packets_df(spark, syns(50, 100, 0.01)))) == []
    got = alerts(detect_syn_flood(packets_df(spark, syns(150, 100, 0.01))))
    assert got == [(100.99, "10.0.0.1", 100, "100 SYN packets within 5s (~20.0 SYN/s, threshold: 100)")]
    rows = [packet(100 + i * 0.01, tcp_flags=f) for i in range(50) for f in ("SA", "A")]
    assert alerts(detect_syn_flood(packets_df(spark, rows), 10, 5, 30)) == []
    rows = syns(9, 0, 0.1) + syns(9, 10, 0.1)
    assert alerts(detect_syn_flood(packets_df(spark, rows), 10, 2, 30)) == []
    assert times(detect_syn_flood(packets_df(spark, syns(6, 1, 0.1) + syns(6, 3, 0.1)), 5, 5, 30)) == [1.4]
    # Other flags beside S still make a SYN; UDP and missing flags do not.
    rows = [packet(1, tcp_flags="SF"), packet(2, tcp_flags="SEC"), packet(3, tcp_flags=None), packet(4, protocol="UDP")]
    assert [a[2] for a in alerts(detect_syn_flood(packets_df(spark, rows), 1, 10, 0))] == [1, 2]


def test_windows_must_be_positive(spark):
    rows = packets_df(spark, syns(2, 0, 1))
    for run in (detect_syn_flood, detect_port_scan, detect_traffic_anomaly):
        with pytest.raises(ValueError, match="positive"):
            run(rows, window_s=0)


def traffic(counts, source="10.0.0.1", flush=True):
    rows = []
    for i, spec in enumerate(counts):
        count, ip = spec if isinstance(spec, tuple) else (spec, source)
        rows += [packet(10.0 * i + j * (10 / count * 0.5), src_ip=ip) for j in range(count)]
    return rows + ([packet(10.0 * len(counts), src_ip=source)] if flush else [])


def test_traffic_anomaly(spark):
    assert alerts(detect_traffic_anomaly(packets_df(spark, traffic([10, 200])))) == []
    assert alerts(detect_traffic_anomaly(packets_df(spark, traffic([20] * 10)))) == []
    [(ts, source, n, details)] = alerts(detect_traffic_anomaly(packets_df(spark, traffic([10, 10, 10, 100]))))
    assert (ts, source, n) == (40.0, "10.0.0.1", 100)
    assert details == (
        "100 packets in 10s window exceeds 3.0x baseline average (10.0 packets); top source: 10.0.0.1 (100 packets)"
    )
    rows = traffic([(10, "10.0.0.5"), (10, "10.0.0.5"), (80, "10.0.0.99")])
    got = alerts(detect_traffic_anomaly(packets_df(spark, rows), multiplier=2, min_samples=2))
    assert got == [
        (
            30.0,
            "10.0.0.99",
            80,
            "80 packets in 10s window exceeds 2x baseline average (10.0 packets); top source: 10.0.0.99 (80 packets)",
        )
    ]


def test_anomaly_joins_the_baseline_and_open_window_is_ignored(spark):
    got = alerts(detect_traffic_anomaly(packets_df(spark, traffic([10, 10, 10, 40, 40, 40, 400], flush=False))))
    assert [a[2] for a in got] == [40]


def test_anomaly_without_any_source(spark):
    rows = traffic([2, 2, 2, (20, None)])
    [(_, source, n, details)] = alerts(detect_traffic_anomaly(packets_df(spark, rows)))
    assert (source, n) == ("unknown", 20) and details.endswith("top source: unknown (0 packets)")


def random_packets(seed, n=500):
    rng = random.Random(seed)
    now, rows = 1_700_000_000.0, []
    for seq in range(n):
        now += rng.choice([0, 0, 0.25, 0.5, 1.0, 3.0]) if (seq // 50) % 4 else rng.choice([0, 0, 0.0625])
        rows.append(
            packet(
                now,
                src_ip=rng.choice(["a", "a", "a", "b", "c", "", None]),
                dst_port=rng.choice([1, 2, 3, 4, 5, 6, None]),
                protocol=rng.choice(["TCP", "TCP", "UDP", "ARP"]),
                tcp_flags=rng.choice(["S", "SA", "", None, "SF"]),
                is_arp=rng.random() < 0.3,
                src_mac=rng.choice([AA, AA, BB, CC, FF, "", None]),
            )
        )
    for seq, row in enumerate(rows):
        row.update(seq=seq, ts_us=round(row["ts"] * MICROS))
    return rows


def keyed(rows, count, threshold, gap, forced=None):
    """Expected ``(seq, observed)`` of a keyed detector over its eligible rows."""
    observed = count(rows)
    out = []
    for key in {r["src_ip"] for r in rows}:
        over = [i for i, r in enumerate(rows) if r["src_ip"] == key and observed[i] >= threshold]
        flags = [forced(rows, i) for i in over] if forced else None
        out += [(rows[over[j]]["seq"], observed[over[j]]) for j in brute.debounce([rows[i]["ts_us"] for i in over], gap, flags)]
    return sorted(out)


@pytest.mark.parametrize("seed", [11, 12])
def test_random_streams(spark, seed):
    rows = random_packets(seed)
    df = packets_df(spark, rows)

    def got(alerts):
        return sorted((r.seq, r.observed) for r in alerts.collect())

    scans = [r for r in rows if r["src_ip"] and r["dst_port"] is not None and r["protocol"] in ("TCP", "UDP")]
    expected = keyed(scans, lambda r: brute.distinct_in_window(r, "src_ip", "dst_port", 4 * MICROS), 4, 6 * MICROS)
    assert got(detect_port_scan(df, 4, 4, 6)) == expected
    assert got(detect_port_scan(df, 4, 4, 6, slice_s=1.5)) == expected

    syn = [r for r in rows if r["src_ip"] and r["protocol"] == "TCP" and r["tcp_flags"] in ("S", "SF")]
    expected = keyed(syn, lambda r: brute.count_in_window(r, "src_ip", 3 * MICROS), 4, 5 * MICROS)
    assert got(detect_syn_flood(df, 4, 3, 5)) == expected

    bound = [r for r in rows if r["is_arp"] and r["src_ip"] and r["src_mac"]]

    def is_new(rows, i):
        return all((r["src_ip"], r["src_mac"]) != (rows[i]["src_ip"], rows[i]["src_mac"]) for r in rows[:i])

    expected = keyed(bound, lambda r: brute.distinct_so_far(r, "src_ip", "src_mac"), 2, 20 * MICROS, is_new)
    assert got(detect_arp_spoof(df, 20, slice_s=10)) == expected

    spikes = brute.anomalies(rows, 5 * MICROS, 4, 1.5, 2)
    assert len(spikes) > 2
    found = detect_traffic_anomaly(df, 5, 4, 1.5, 2).orderBy("ts_us").collect()
    assert [(r.ts_us, r.seq, r.observed, r.source_ip) for r in found] == [(s[0], s[1], s[2], s[4]) for s in spikes]
    for r, s in zip(found, spikes, strict=True):
        assert r.details == (
            f"{s[2]} packets in 5s window exceeds 1.5x baseline average ({s[3]:.1f} packets); "
            f"top source: {s[4]} ({s[5]} packets)"
        )
