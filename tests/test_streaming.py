"""A stream over files in arrival order gives the alerts of the batch operators."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from brute import debounce, packet, packets_df
from pyspark.sql import functions as F
from test_detectors import random_packets
from test_kernels import stream

from wiretide.operators.detectors import (
    detect_arp_spoof,
    detect_port_scan,
    detect_syn_flood,
    detect_traffic_anomaly,
)
from wiretide.operators import sliding
from wiretide.operators.detectors import syn_flood_alerts
from wiretide.operators.whitelist import exclude_whitelisted
from wiretide.plans import registry
from wiretide.plans.engine import assign_ids, detect_all, register_detector, unregister_detector
from wiretide.plans.store import append_alerts, read_alerts
from wiretide.sources.packets import load_packets
from wiretide.streaming.folds import arrival_counts, arrival_distinct, fired_positions, live_counts, live_distinct_counts
from wiretide.streaming.memory import StreamMemory
from wiretide.streaming.processors import ArpSpoofProcessor
from wiretide.streaming.steps import port_scan_step, syn_flood_step
from wiretide.streaming.streams import (
    TrafficAnomalyStream,
    start_alert_sink,
    start_detect_all,
    stream_detect,
    stream_failures,
    stream_summary,
)

COLUMNS = ["seq", "ts_us", "source_ip", "event_type", "observed", "details"]


def write_files(df, path, cuts):
    for low, high in zip([0, *cuts], [*cuts, 10**9], strict=True):
        part = df.filter((df.seq >= low) & (df.seq < high)).coalesce(1)
        part.drop("ts_us", "event_time").write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def replay(spark, packets, tmp_path, detector, **params):
    stream = load_packets(spark, packets, streaming=True, maxFilesPerTrigger="1")
    path = f"{tmp_path}/{detector}"
    alerts = stream_detect(stream, detector, **params)
    start_alert_sink(alerts, f"{path}/log", f"{path}/checkpoint", available_now=True).awaitTermination()
    return read_alerts(spark, f"{path}/log")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    df = packets_df(spark, random_packets(21))
    path = str(tmp_path_factory.mktemp("packets"))
    write_files(df, path, [130, 131, 390])
    return df, path


def test_port_scan(spark, source, tmp_path):
    df, path = source
    got = replay(spark, path, tmp_path, "port_scan", port_threshold=4, window_s=4, cooldown_s=6)
    expected = rows_of(detect_port_scan(df, 4, 4, 6))
    assert rows_of(got) == expected and len(expected) > 3
    assert sorted(r.id for r in got.collect()) == list(range(1, len(expected) + 1))


def test_syn_flood(spark, source, tmp_path):
    df, path = source
    expected = rows_of(detect_syn_flood(df, 2, 3, 5))
    assert rows_of(replay(spark, path, tmp_path, "dos", syn_threshold=2, window_s=3, cooldown_s=5)) == expected
    assert len(expected) > 3


def test_arp_spoof(spark, source, tmp_path):
    df, path = source
    expected = rows_of(detect_arp_spoof(df, 20))
    assert rows_of(replay(spark, path, tmp_path, "arp_spoof", cooldown_s=20)) == expected
    assert len(expected) > 3


def test_traffic_anomaly(spark, source, tmp_path):
    df, path = source
    expected = rows_of(detect_traffic_anomaly(df, 5, 4, 1.5, 2))
    stream = TrafficAnomalyStream(f"{tmp_path}/log", f"{tmp_path}/state", 5, 4, 1.5, 2)
    packets = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    stream.start(packets, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert rows_of(read_alerts(spark, f"{tmp_path}/log")) == expected and len(expected) > 2


def test_late_packets_are_dropped_only_with_a_watermark(spark, tmp_path):
    def flood(at):
        return [packet(at + i / 10) for i in range(4)]

    # The third file is far behind the first two; the last one lets the watermark pass the others.
    late = [packet(100 + i / 10, src_ip="late") for i in range(4)]
    df = packets_df(spark, flood(1000) + flood(5000) + late + [packet(9000, src_ip="last")])
    path = str(tmp_path / "packets")
    write_files(df, path, [4, 8, 12])
    params = {"syn_threshold": 3, "window_s": 5, "cooldown_s": 30}
    kept = replay(spark, path, tmp_path / "all", "dos", **params)
    assert sorted(r.source_ip for r in kept.collect()) == ["10.0.0.1", "10.0.0.1", "late"]
    stream = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    alerts = stream_detect(stream, "dos", watermark="1 minute", **params)
    query = start_alert_sink(alerts, f"{tmp_path}/cut/log", f"{tmp_path}/cut/checkpoint", available_now=True)
    query.awaitTermination()
    assert [r.source_ip for r in read_alerts(spark, f"{tmp_path}/cut/log").collect()] == ["10.0.0.1", "10.0.0.1"]
    dropped = [s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(dropped) == 4


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Packets of the same sources that arrive up to 8 s late, and one far behind them all."""
    rng = random.Random(8)
    rows = [r for r in random_packets(33) if r["src_ip"]]
    df = packets_df(spark, [*rows, packet(rows[-1]["ts"] + 1000, src_ip="last", is_arp=True)])
    path = str(tmp_path_factory.mktemp("late"))
    order = sorted(range(len(rows)), key=lambda i: rows[i]["ts"] + rng.uniform(0, 8))
    batch_of = {seq: k * 4 // len(rows) for k, seq in enumerate(order)} | {len(rows): 3}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in batch_of.items() for x in pair]), F.col("seq"))
    for k in range(4):
        df.filter(place == k).drop("ts_us", "event_time").coalesce(1).write.mode("append").parquet(path)
    return df.filter("src_ip <> 'last'"), path


@pytest.mark.parametrize("detector", ["port_scan", "dos", "arp_spoof"])
def test_packets_within_the_watermark_may_come_in_any_order(spark, shuffled, tmp_path, detector):
    df, path = shuffled
    batch, params = {
        "port_scan": (detect_port_scan(df, 4, 4, 6), {"port_threshold": 4, "window_s": 4, "cooldown_s": 6}),
        "dos": (detect_syn_flood(df, 2, 3, 5), {"syn_threshold": 2, "window_s": 3, "cooldown_s": 5}),
        "arp_spoof": (detect_arp_spoof(df, 20), {"cooldown_s": 20}),
    }[detector]
    expected = rows_of(batch)
    assert rows_of(replay(spark, path, tmp_path, detector, watermark="8 seconds", **params)) == expected
    assert len(expected) > 3


def test_late_packets_and_traffic_windows(spark, shuffled, tmp_path):
    df, path = shuffled
    expected = rows_of(detect_traffic_anomaly(df, 5, 4, 1.5, 2))
    stream = TrafficAnomalyStream(f"{tmp_path}/log", f"{tmp_path}/state", 5, 4, 1.5, 2, lateness_s=8)
    packets = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    stream.start(packets, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert rows_of(read_alerts(spark, f"{tmp_path}/log")) == expected and len(expected) > 2
    assert stream.late(spark, 3) == 0


def one_by_one_windows(rows, window):
    """(start, packets) of each window, as packets come."""
    out = []
    for t in rows:
        if not out or t - out[-1][0] >= window:
            out.append([t, 0])
        out[-1][1] += 1
    return out


def test_a_late_packet_moves_no_window(spark, tmp_path):
    """Without a lateness, windows are those of the packets one after the other, whatever their times."""
    rng = random.Random(3)
    times = [1000 + i * 0.7 - rng.choice([0, 0, 0, 4, 15]) for i in range(90)] + [1100 + i / 100 for i in range(60)] + [1200]
    rows = [packet(t) for t in times]
    df = packets_df(spark, rows)
    windows = one_by_one_windows([round(t * 1e6) for t in times], 10_000_000)
    stream = TrafficAnomalyStream(f"{tmp_path}/log", f"{tmp_path}/state", 10, 4, 1.5, 2)
    found = []
    cuts = [0, 13, 40, 41, 100, len(rows)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = df.filter((F.col("seq") >= a) & (F.col("seq") < b)).select("seq", "ts_us", "src_ip")
        found += stream.alerts(part, k).collect()
    expected = []
    for i in range(2, len(windows) - 1):
        before = [n for _, n in windows[max(0, i - 4) : i]]
        if windows[i][1] > 1.5 * sum(before) / len(before):
            expected.append((windows[i + 1][0], windows[i][1]))
    assert [(r.ts_us, r.observed) for r in found] == expected and expected


def test_dropped_packets_are_counted(spark, tmp_path):
    df = packets_df(spark, [packet(100), packet(200), packet(150), packet(198), packet(300)]).select("seq", "ts_us", "src_ip")
    stream = TrafficAnomalyStream(f"{tmp_path}/log", f"{tmp_path}/state", 10, 4, 1.5, 2, lateness_s=5)
    stream.alerts(df.filter("seq < 2"), 0)
    stream.alerts(df.filter("seq >= 2"), 1)
    assert stream.late(spark, 1) == 1


def test_one_log_for_all(spark, source, tmp_path):
    """All detectors in one stream: the alerts of the batch run, numbered by (arrival, detector)."""
    df, path = source
    params = {
        "port_scan": {"port_threshold": 4, "time_window": 4, "cooldown": 6},
        "arp_spoof": {"cooldown": 20},
        "dos": {"syn_threshold": 2, "time_window": 3, "cooldown": 5},
        "traffic_anomaly": {"window_seconds": 5, "baseline_windows": 4, "multiplier": 1.5, "min_baseline_samples": 2},
    }
    expected = assign_ids(detect_all(df, params, whitelist=["10.0.0.2"]))
    packets = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    log = f"{tmp_path}/log"
    args = (log, f"{tmp_path}/checkpoint", f"{tmp_path}/state", params)
    start_detect_all(packets, *args, whitelist=["10.0.0.2"], available_now=True).awaitTermination()
    view = lambda x: sorted(tuple(r) for r in x.select("id", *COLUMNS).collect())
    assert view(read_alerts(spark, log)) == view(expected) and len(view(expected)) > 10


def test_writers_leave_each_other_s_alerts(spark, source, tmp_path):
    """A batch run, two streams, and a stream that begins again, on one log."""
    df, path = source
    log = f"{tmp_path}/log"
    batch = detect_syn_flood(df, 2, 3, 5).withColumn("detector_ordinal", F.lit(0))
    append_alerts(batch, log)
    expected = rows_of(batch)
    for k, (detector, params) in enumerate(
        [("dos", {"syn_threshold": 2, "window_s": 3, "cooldown_s": 5}), ("arp_spoof", {"cooldown_s": 20}), ("arp_spoof", {"cooldown_s": 20})]
    ):
        packets = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
        alerts = stream_detect(packets, detector, **params)
        start_alert_sink(alerts, log, f"{tmp_path}/checkpoint{k}", available_now=True).awaitTermination()
        expected = sorted(expected + rows_of(detect_syn_flood(df, 2, 3, 5) if detector == "dos" else detect_arp_spoof(df, 20)))
        assert rows_of(read_alerts(spark, log)) == expected
    assert sorted(r.id for r in read_alerts(spark, log).collect()) == list(range(1, len(expected) + 1))


def test_forgotten_addresses_are_not_counted():
    """The count is that of the MACs that are left."""
    macs = {}

    class Map:
        def keys(self):
            return [(m,) for m in macs]

        def updateValue(self, key, value):  # noqa: N802
            macs[key[0]] = value

    class Value:
        def exists(self):
            return False

        def update(self, value):
            pass

    processor = ArpSpoofProcessor(0, ttl_ms=1000)
    processor.macs, processor.state = Map(), Value()
    rows = lambda *m: pd.DataFrame({"ts_us": range(len(m)), "seq": range(len(m)), "src_mac": m})
    first = list(processor.fold("ip", rows("a", "b")))
    assert first[0]["observed"].tolist() == [2]
    macs.clear()
    assert list(processor.fold("ip", rows("c"))) == []
    again = list(processor.fold("ip", rows("c", "d")))
    assert again[0]["observed"].tolist() == [2] and again[0]["items"].tolist() == [["c", "d"]]


class Entries:
    """A map state in memory, which counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.rows.get(key[0])

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key[0]] = value


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def arp_rows(rows):
    return pd.DataFrame(rows, columns=["src_ip", "src_mac", "ts_us", "seq"])


def test_a_group_holds_many_sources():
    """A bucket of sources is one group: each source by itself, with two calls of the state for those that have rows."""
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(40)}", f"m{rng.randrange(3)}", 1000 * k, k) for k in range(600)]
    processor, found = ArpSpoofProcessor(20_000), []
    processor.sources = Entries()
    for a, b in [(0, 250), (250, 251), (251, 600)]:
        batch = rows[a:b]
        rng.shuffle(batch)
        processor.sources.calls = 0
        for part in processor.handleInputRows((7,), iter([arp_rows(batch)]), None):
            found += list(part.itertuples(index=False, name=None))
        assert processor.sources.calls <= 1 + 2 * len({r[0] for r in batch})
    expected, macs, opens = [], {}, {}
    for source, mac, t, seq in rows:
        known = macs.setdefault(source, set())
        forced = mac not in known
        known.add(mac)
        if len(known) > 1 and (forced or t >= opens.get(source, 0)):
            expected.append((source, t, seq, len(known), sorted(known)))
            opens[source] = t + 20_000
    assert sorted(found) == sorted(expected) and len(expected) > 40


def test_a_mac_is_forgotten_when_its_time_is_over():
    processor = ArpSpoofProcessor(0, ttl_ms=1000)
    processor.sources = Entries()
    run = lambda now, *rows: [list(p["items"]) for p in processor.handleInputRows((0,), iter([arp_rows(list(rows))]), Now(now))]
    assert run(0, ("x", "a", 1, 1), ("y", "a", 2, 2)) == []
    assert run(600, ("x", "b", 3, 3)) == [[["a", "b"]]]
    assert run(1200, ("x", "c", 4, 4), ("y", "b", 5, 5)) == [[["b", "c"]]]


def test_large_micro_batches_come_in_more_files(spark, monkeypatch):
    rows = packets_df(spark, random_packets(21))
    part = lambda: F.floor(F.col("seq") * registry.BATCHES / F.lit(rows.count()))
    sizes, written = [], []
    fresh = registry.scratch_path
    monkeypatch.setattr(registry, "scratch_path", lambda s: written.append(fresh(s).removeprefix("file:")) or written[-1])
    for worth in (registry.FILE_ROWS, 5):
        monkeypatch.setattr(registry, "FILE_ROWS", worth)
        stream = registry._in_batches(rows, part())
        seen = []
        query = stream.writeStream.foreachBatch(lambda batch, _, seen=seen: seen.append(sorted(r.seq for r in batch.collect())))
        query.trigger(availableNow=True).option("checkpointLocation", fresh(spark)).start().awaitTermination()
        assert [len(seen), sum(seen, [])] == [registry.BATCHES, sorted(r.seq for r in rows.collect())]
        sizes.append(len(list(Path(written[-1]).glob("*.parquet"))))
    assert sizes == [registry.BATCHES * registry.FILES, registry.BATCHES * 2 * spark.sparkContext.defaultParallelism]


def test_folds_in_the_order_of_arrival():
    """Late rows, one after the other: what is before the window goes from the front, an expired port stays out."""
    rng = random.Random(6)
    for _ in range(200):
        ts = np.array([100 + 2 * i - rng.choice([0, 0, 5, 30]) for i in range(30)])
        port = np.array([rng.randrange(6) for _ in ts])
        times, ports, counts, distinct = [], {}, [], []
        for t, p in zip(ts.tolist(), port.tolist(), strict=True):
            times.append(t)
            while times[0] < t - 9:
                times.pop(0)
            counts.append(len(times))
            ports[p] = t
            ports = {q: s for q, s in ports.items() if s >= t - 9}
            distinct.append(dict(ports))
        cut = rng.randrange(30)
        first, held = arrival_counts([], ts[:cut], 9)
        second, held = arrival_counts(held, ts[cut:], 9)
        assert first + second == counts and held == times
        seen = {}
        assert [dict(x) for x in arrival_distinct(seen, ts, port, 9)] == distinct and seen == ports
        forced = np.array([rng.random() < 0.1 for _ in ts])
        fired, opens = [], -(2**62)
        for i, t in enumerate(ts.tolist()):
            if forced[i] or t >= opens:
                fired.append(i)
                opens = t + 7
        assert fired_positions(ts, -(2**62), 7, forced) == (fired, opens)


SETTINGS = {
    "port_scan": {"port_threshold": 4, "time_window": 4, "cooldown": 6},
    "dos": {"syn_threshold": 2, "time_window": 3, "cooldown": 5},
}


def run_all(spark, path, folder, **options):
    packets = load_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    start_detect_all(packets, f"{folder}/log", f"{folder}/checkpoint", f"{folder}/state", SETTINGS, available_now=True, **options).awaitTermination()
    return read_alerts(spark, f"{folder}/log")


def test_a_hot_source_is_spread(spark, tmp_path, monkeypatch):
    """One source with 90 % of a micro-batch: its rows are counted in at least four tasks, and the alerts are those of the table."""
    rng = random.Random(4)
    rows = [packet(1000 + k / 2000, src_ip="hot" if rng.random() < 0.9 else f"q{rng.randrange(50)}", dst_port=rng.randrange(60)) for k in range(20_000)]
    df = packets_df(spark, rows)
    laid = []
    count_live = sliding._count_live
    monkeypatch.setattr(sliding, "_count_live", lambda rows, *a: laid.append(rows) or count_live(rows, *a))
    memory = StreamMemory(spark, f"{tmp_path}/scan", 0, False)
    found = rows_of(port_scan_step(df, {"port_threshold": 20, "time_window": 0.5, "cooldown": 1}, memory))
    assert found == rows_of(detect_port_scan(df, 20, 0.5, 1)) and found
    spread = laid[0].repartition(4, "src_ip", "_slice").filter("src_ip = 'hot' AND _own")
    slices = [r["count"] for r in spread.groupBy("_slice").count().collect()]
    assert sum(slices) > 17_000 and len(slices) >= 6 and max(slices) < 6000
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_steps_in_the_order_of_arrival(spark, tmp_path):
    """Late packets without a watermark: every micro-batch gives what one pass over the packets in the order of arrival gives."""
    rng = random.Random(12)
    rows = []
    for k in range(600):
        source = f"s{k % 3}"
        late = rng.choice([0, 0, 0, 2, 9]) if source != "s0" else 0
        rows.append(packet(1000 + k / 8 - late, src_ip=source, dst_port=rng.randrange(8)))
    df = packets_df(spark, rows)
    steps = {"port_scan": port_scan_step, "dos": syn_flood_step}
    p = {"port_threshold": 4, "syn_threshold": 9, "time_window": 4.0, "cooldown": 6.0}
    found = {name: [] for name in steps}
    for k, (a, b) in enumerate([(0, 90), (90, 91), (91, 340), (340, 600)]):
        part = df.filter((F.col("seq") >= a) & (F.col("seq") < b))
        for name, step in steps.items():
            memory = StreamMemory(spark, f"{tmp_path}/{name}", k, False)
            found[name] += [(r.source_ip, r.seq, r.observed, r["items"]) for r in step(part, p, memory).collect()]
            memory.finish()
    expected = {name: [] for name in steps}
    for source in ("s0", "s1", "s2"):
        times, ports, opens = [], {}, {name: 0 for name in steps}
        for seq, r in enumerate(rows):
            if r["src_ip"] != source:
                continue
            t = round(r["ts"] * 1e6)
            times.append(t)
            while times[0] < t - 4_000_000:
                times.pop(0)
            ports[r["dst_port"]] = t
            ports = {q: s for q, s in ports.items() if s >= t - 4_000_000}
            if len(times) >= 9 and t >= opens["dos"]:
                opens["dos"] = t + 6_000_000
                expected["dos"].append((source, seq, len(times), None))
            if len(ports) >= 4 and t >= opens["port_scan"]:
                opens["port_scan"] = t + 6_000_000
                expected["port_scan"].append((source, seq, len(ports), [str(q) for q in sorted(ports)]))
    for name in steps:
        assert sorted(found[name], key=str) == sorted(expected[name], key=str) and len(expected[name]) > 10


def test_a_step_run_again_gives_the_same(spark, tmp_path):
    df = packets_df(spark, random_packets(21))
    p = SETTINGS["dos"]
    first = df.filter("seq < 200")
    memory = StreamMemory(spark, f"{tmp_path}/dos", 0, False)
    syn_flood_step(first, p, memory).collect()
    memory.finish()
    runs = []
    for _ in range(2):
        memory = StreamMemory(spark, f"{tmp_path}/dos", 1, False)
        runs.append(rows_of(syn_flood_step(df.filter("seq >= 200"), p, memory)))
        memory.finish()
    assert runs[0] == runs[1] == [r for r in rows_of(detect_syn_flood(df, 2, 3, 5)) if r[0] >= 200]


def test_a_failing_detector_leaves_the_others_and_catches_up(spark, source, tmp_path):
    """A detector that fails in the second micro-batch gets its rows with the third; one that always fails never alerts."""
    df, path = source
    seen = []

    def broken(packets, _settings, memory=None):
        raise ValueError("never works")

    def shaky(packets, _settings, memory):
        seen.append(packets.count())
        if memory.batch_id == 1:
            raise ValueError("once")
        return detect_traffic_anomaly(packets.limit(0)).unionByName(packets_as_alerts(packets))

    def packets_as_alerts(packets):
        return detect_syn_flood(packets.withColumns({"src_ip": F.col("seq").cast("string"), "protocol": F.lit("TCP"), "tcp_flags": F.lit("S")}), 1, 1, 0)

    register_detector("broken", broken, stream=broken)
    register_detector("shaky", lambda packets, _: packets_as_alerts(packets), stream=shaky)
    try:
        found = run_all(spark, path, tmp_path, enabled=["broken", "dos", "shaky"])
    finally:
        unregister_detector("broken")
        unregister_detector("shaky")
    everything = rows_of(found)
    expected = rows_of(detect_syn_flood(df, 2, 3, 5))
    assert [r for r in everything if r[2] in {e[2] for e in expected}] == expected
    assert sorted(int(r[2]) for r in everything if r[2].isdigit()) == list(range(df.count()))
    assert len(seen) == 4 and seen[2] > seen[1]
    failed = sorted((r.detector, r.batch_id) for r in stream_failures(spark, f"{tmp_path}/state").collect())
    assert failed == [("broken", k) for k in range(4)] + [("shaky", 1)]
    assert stream_summary(spark, f"{tmp_path}/state").first() == (df.count(), len(everything), 0)


def test_own_detectors_in_batch_and_stream(spark, source, tmp_path):
    """A detector with tables of its own from micro-batch to micro-batch: the first packet of each source."""
    df, path = source

    def first_packets(packets, _settings):
        first = packets.filter("src_ip <> ''").groupBy("src_ip").agg(F.min(F.struct("ts_us", "seq")).alias("f")).select("src_ip", "f.*")
        return syn_flood_alerts(first.withColumn("observed", F.lit(1)), 1, 1)

    def step(packets, settings, memory):
        known = memory.read("known", "src_ip string")
        new = packets.join(known, "src_ip", "left_anti")
        memory.write("known", known.unionByName(new.select("src_ip").distinct()))
        return first_packets(new, settings)

    register_detector("first_packets", first_packets, stream=step)
    try:
        found = run_all(spark, path, tmp_path, enabled="first_packets")
        assert rows_of(found) == rows_of(detect_all(df, enabled="first_packets")) and found.count() == 3
    finally:
        unregister_detector("first_packets")
    register_detector("no_stream", first_packets)
    try:
        with pytest.raises(ValueError, match="no streaming form"):
            run_all(spark, path, tmp_path / "none", enabled="no_stream")
    finally:
        unregister_detector("no_stream")


def test_late_packets_of_a_stream_are_counted(spark, tmp_path):
    """Held back, taken in the order of time, dropped when too late: for all detectors of a stream."""
    rows = [packet(1000 + i / 10) for i in range(4)] + [packet(990.0)] + [packet(1003.0), packet(995.5), packet(1002.9)] + [packet(2000.0)]
    df = packets_df(spark, rows)
    path = str(tmp_path / "packets")
    write_files(df, path, [4, 5, 8])
    found = run_all(spark, path, tmp_path / "out", enabled=["dos"], lateness_s=5)
    # 990 is older than 1000.3 - 5, 995.5 is not older than that.
    in_time = [r for k, r in enumerate(rows) if k not in (4, 8)]
    expected = detect_syn_flood(packets_df(spark, sorted(in_time, key=lambda r: r["ts"])), 2, 3, 5)
    assert [(r.ts_us, r.observed) for r in found.orderBy("ts_us").collect()] == [(r.ts_us, r.observed) for r in expected.orderBy("ts_us").collect()]
    assert stream_summary(spark, f"{tmp_path}/out/state").first() == (9, found.count(), 1)


def test_long_whitelists_of_a_stream_are_joined(spark, source, tmp_path):
    df, path = source
    entries = [f"172.16.{i // 250}.{i % 250}" for i in range(2500)] + ["10.0.0.0/24", "2001:db8::/32"]
    odd = packets_df(spark, [packet(k, src_ip=s) for k, s in enumerate(["10.0.0.7", "10.0.1.7", "172.16.3.3", "172.17.3.3", "2001:db8::1", "x", None])])
    folder = str(tmp_path / "odd")
    write_files(odd, folder, [3])
    kept = exclude_whitelisted(load_packets(spark, folder, streaming=True), entries)
    query = kept.select("seq").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query.start(f"{tmp_path}/kept").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 3, 5, 6]
    assert sorted(r.seq for r in exclude_whitelisted(odd, entries).collect()) == [1, 3, 5, 6]


def test_streams_need_arrival_numbers(spark, source):
    _, path = source
    with pytest.raises(ValueError, match="not keyed"):
        stream_detect(load_packets(spark, path, streaming=True), "traffic_anomaly")


def test_folds():
    rows = [r for r in stream(9, 300) if r["src_ip"] == "hot"]
    ts, value = np.array([r["ts_us"] for r in rows]), np.array([r["v"] for r in rows])
    window = 5_000_000
    inside = [[v for t, v in zip(ts[: i + 1], value[: i + 1], strict=True) if t >= ts[i] - window] for i in range(len(ts))]
    assert live_counts(ts, window).tolist() == [len(x) for x in inside]
    assert live_distinct_counts(ts, value, window).tolist() == [len(set(x)) for x in inside]
    for must in (None, value == 2):
        fired, opens = fired_positions(ts, -(2**62), 3_000_000, must)
        assert fired == debounce(ts.tolist(), 3_000_000, must if must is None else must.tolist())
        assert opens == ts[fired[-1]] + 3_000_000
