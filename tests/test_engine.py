from __future__ import annotations

import json
import threading
import time
from pathlib import Path

import pytest
from brute import packet, packets_df
from pyspark.sql import functions as F

from wiretide import scratch
from wiretide.operators.detectors import detect_port_scan
from wiretide.plans import store
from wiretide.plans.engine import (
    assign_ids,
    detect_all,
    detect_isolated,
    register_detector,
    select_detectors,
    session_summary,
    unregister_detector,
)
from wiretide.plans.params import DEFAULTS, settings
from wiretide.schema import ALERT_SCHEMA
from wiretide.sources.packets import as_packets, load_packets, timed

ONE_PORT = {"port_scan": {"port_threshold": 1}}


def scan(first=1.0, count=5, **changes):
    return [packet(first + i, dst_port=i, **changes) for i in range(count)]


def test_settings_merge_leaf_by_leaf():
    assert settings() == DEFAULTS and settings({}) == DEFAULTS
    merged = settings({"dos": {"cooldown": 1, "typo": 2}, "unknown": {}, "whitelist": ["10.0.0.1"]})
    assert merged["dos"] == {**DEFAULTS["dos"], "cooldown": 1}
    assert merged["port_scan"] == DEFAULTS["port_scan"] and merged["whitelist"] == ["10.0.0.1"]
    assert "unknown" not in merged and DEFAULTS["whitelist"] == []
    with pytest.raises(ValueError):
        settings(["not", "a", "mapping"])


def test_selection():
    names = ["port_scan", "arp_spoof", "dos", "traffic_anomaly"]
    assert select_detectors() == names
    assert select_detectors({"arp_spoof": {"enabled": False}}) == ["port_scan", "dos", "traffic_anomaly"]
    assert select_detectors({"dos": {"enabled": False}}, ["dos", "port_scan"]) == ["port_scan", "dos"]
    assert select_detectors(None, " dos , port_scan,") == ["port_scan", "dos"]
    with pytest.raises(ValueError, match="port_scan"):
        select_detectors(None, ["nope"])
    with pytest.raises(ValueError):
        select_detectors(None, " , ")


def test_summary_counts_whitelisted_packets(spark):
    rows = packets_df(spark, scan())
    alerts = detect_all(rows, {"port_scan": {"port_threshold": 3}}, ["port_scan"])
    assert session_summary(rows, alerts).first() == (5, 1)
    assert alerts.first().ts_us == 3_000_000
    one = packets_df(spark, scan(count=1))
    assert session_summary(one, detect_all(one, ONE_PORT, ["port_scan"], ["10.0.0.1"])).first() == (1, 0)


@pytest.mark.parametrize(
    ("source", "whitelist", "n"),
    [
        ("10.0.0.1", ["10.0.0.1"], 0),
        ("10.0.0.42", ["10.0.0.0/24"], 0),
        ("203.0.113.5", ["192.168.1.1", "10.0.0.0/24"], 1),
        ("2001:db8::5", ["2001:db8::/64"], 0),
        ("garbage", ["0.0.0.0/0", "::/0"], 1),
    ],
)
def test_whitelist(spark, source, whitelist, n):
    rows = packets_df(spark, [packet(1.0, src_ip=source, dst_port=1)])
    assert detect_all(rows, ONE_PORT, ["port_scan"], whitelist).count() == n
    assert detect_all(rows, {**ONE_PORT, "whitelist": whitelist}, ["port_scan"]).count() == n


def test_whitelisted_packets_stay_out_of_the_windows(spark):
    noise = [packet(t / 10, src_ip="10.0.0.9") for t in range(390)]
    rows = [packet(10.0 * w + i, src_ip="10.0.0.1") for w in range(3) for i in range(2)]
    rows += [packet(30 + i / 100) for i in range(50)] + [packet(40)]
    both = packets_df(spark, sorted(rows + noise, key=lambda r: r["ts"]))
    assert detect_all(both, None, "traffic_anomaly").count() == 0
    [alert] = detect_all(both, None, "traffic_anomaly", ["10.0.0.9"]).collect()
    assert alert.observed == 50


def test_custom_detector_runs_after_the_built_in_ones(spark):
    register_detector("sensitive", lambda packets, p: detect_port_scan(packets, p.get("ports", 2)))
    try:
        assert select_detectors()[-1] == "sensitive"
        got = detect_all(packets_df(spark, scan()), {"sensitive": {"ports": 4}}, "sensitive").collect()
        assert [(r.observed, r.detector_ordinal) for r in got] == [(4, 4)]
    finally:
        unregister_detector("sensitive")


def test_a_failing_detector_leaves_the_others_running(spark):
    def broken(packets, _):
        return detect_port_scan(packets.withColumn("dst_port", F.raise_error(F.lit("boom")).cast("int")))

    register_detector("broken", broken)
    try:
        alerts, statuses = detect_isolated(packets_df(spark, scan()), {"port_scan": {"port_threshold": 3}}, ["broken", "port_scan"])
    finally:
        unregister_detector("broken")
    assert alerts.count() == 1
    assert [(s.detector, s.ok, s.alerts) for s in statuses] == [("port_scan", True, 1), ("broken", False, 0)]
    assert "boom" in statuses[1].error


def test_ids_follow_arrival_then_detector(spark):
    rows = packets_df(spark, [packet(1.0 + i / 10, dst_port=i) for i in range(4)])
    params = {"port_scan": {"port_threshold": 2, "cooldown": 0}, "dos": {"syn_threshold": 2, "cooldown": 0}}
    got = assign_ids(detect_all(rows, params, ["dos", "port_scan"]), 10).orderBy("id").collect()
    assert [(r.id, r.seq, r.event_type) for r in got] == [
        (10 + i, 1 + i // 2, ("PORT_SCAN", "SYN_FLOOD")[i % 2]) for i in range(6)
    ]


def test_packet_sources(spark, tmp_path):
    rows = packets_df(spark, scan())
    for fmt in ("parquet", "orc", "json", "csv"):
        path = f"{tmp_path}/{fmt}"
        rows.drop("ts_us", "event_time").write.format(fmt).save(path)
        got = load_packets(spark, path, fmt).orderBy("seq")
        assert got.columns == rows.columns and got.collect() == rows.orderBy("seq").collect()
    with pytest.raises(ValueError):
        load_packets(spark, "x", "pcap")
    with pytest.raises(ValueError, match="ts"):
        as_packets(spark.createDataFrame([("a",)], "src_ip string"))
    bare = as_packets(spark.createDataFrame([(1.5,)], "ts double")).first()
    assert bare.ts_us == 1_500_000 and bare.is_arp is False and bare.length == 0 and bare.src_ip is None
    with pytest.raises(Exception, match="without a time"):
        timed(as_packets(spark.createDataFrame([(None,)], "ts double"))).collect()


def alert(seq, source="10.0.0.1", kind="PORT_SCAN", ts_us=1_000_000):
    return {"seq": seq, "ts_us": ts_us, "source_ip": source, "event_type": kind, "details": "d", "observed": 1}


def log_of(spark, path, *batches):
    for batch in batches:
        df = spark.createDataFrame([tuple(a.get(f.name) for f in ALERT_SCHEMA) for a in batch], ALERT_SCHEMA)
        store.append_alerts(df.withColumn("detector_ordinal", F.lit(0)), str(path))
    return store.read_alerts(spark, str(path))


def test_lines_are_written_in_the_order_of_ids(spark, tmp_path):
    path, lines = str(tmp_path / "log"), str(tmp_path / "lines")
    rows = [alert(seq, f"10.0.0.{seq}") for seq in (7, 3, 9, 1, 5)]
    df = spark.createDataFrame([tuple(a.get(f.name) for f in ALERT_SCHEMA) for a in rows], ALERT_SCHEMA).withColumn("detector_ordinal", F.lit(0))
    for _ in range(2):  # run again, the batch replaces its lines
        assert store.append_alerts(df, path, 4, "stream", lines) == 5
    files = sorted((tmp_path / "lines" / "writer=stream" / "batch_id=4").glob("part-*"))
    written = [line for f in files for line in f.read_text().splitlines()]
    assert written == [f"ALERT [PORT_SCAN] source=10.0.0.{seq} :: d" for seq in (1, 3, 5, 7, 9)]


def test_newest_events_open_the_last_batches_only(spark, tmp_path):
    path = str(tmp_path / "log")
    batches = [[alert(10 * k + j, f"10.0.0.{k % 4}", "ARP_SPOOF" if k == 1 else "PORT_SCAN") for j in range(3)] for k in range(10)]
    log = log_of(spark, path, *batches)
    ids = lambda df: [r.id for r in df.collect()]
    found = store.newest_events(spark, path, 5)
    assert ids(found) == ids(store.recent_events(log, 5)) == [30, 29, 28, 27, 26]
    assert len({f.split("writer=")[1].split("/")[0] for f in found.inputFiles()}) == 2
    for options in [(4, "ARP_SPOOF"), (2, "ARP_SPOOF"), (7, None, "10.0.0.2"), (3, "PORT_SCAN", "10.0.0.1"), (0,), (100,)]:
        found = store.newest_events(spark, path, *options)
        assert ids(found) == ids(store.recent_events(log, *options))
        assert found.columns == log.columns
    # A reservation whose batch was never written, and a batch written again.
    store._Ids(spark, path).reserve("gone", 0, 4)
    df = spark.createDataFrame([tuple(alert(1).get(f.name) for f in ALERT_SCHEMA)], ALERT_SCHEMA).withColumn("detector_ordinal", F.lit(0))
    for _ in range(2):
        store.append_alerts(df, path, 3, "stream")
    assert ids(store.newest_events(spark, path, 3)) == [35, 30, 29]
    assert ids(store.newest_events(spark, f"{tmp_path}/none", 3)) == []
    with pytest.raises(ValueError, match="negative"):
        store.newest_events(spark, path, -1)


def test_log_reads(spark, tmp_path):
    assert store.event_count(store.read_alerts(spark, f"{tmp_path}/none")).first()[0] == 0
    log = log_of(
        spark,
        tmp_path / "log",
        [alert(5, "10.0.0.0"), alert(9, "10.0.0.1", "ARP_SPOOF")],
        [alert(1, "10.0.0.2"), alert(2, "10.0.0.2", "CUSTOM", 1_700_000_000_123_456)],
    )
    assert [(r.id, r.seq) for r in log.orderBy("id").collect()] == [(1, 5), (2, 9), (3, 1), (4, 2)]
    newest = store.recent_events(log).collect()
    assert [r.id for r in newest] == [4, 3, 2, 1]
    assert [r.id for r in store.recent_events(log, 2).collect()] == [4, 3]
    assert store.recent_events(log, 0).collect() == []
    assert [r.id for r in store.recent_events(log, 0, capped=True).collect()] == [4, 3, 2, 1]
    assert [r.id for r in store.recent_events(log, event_type="PORT_SCAN").collect()] == [3, 1]
    assert [r.id for r in store.recent_events(log, event_type="PORT_SCAN", source_ip="10.0.0.0").collect()] == [1]
    assert store.recent_events(log, event_type="", source_ip=None).count() == 4
    assert {r.event_type: r.n for r in store.events_per_type(log).collect()} == {"PORT_SCAN": 2, "ARP_SPOOF": 1, "CUSTOM": 1}
    assert store.stats(log).first() == (4, {"PORT_SCAN": 2, "ARP_SPOOF": 1, "CUSTOM": 1})
    assert [(r.card, r.n) for r in store.type_cards(log).collect()] == [
        ("TOTAL", 4),
        ("PORT_SCAN", 2),
        ("ARP_SPOOF", 1),
        ("SYN_FLOOD", 0),
        ("TRAFFIC_ANOMALY", 0),
    ]
    texts = [json.loads(r.json) for r in store.alerts_json(log).orderBy("id").collect()]
    assert texts[0] == {
        "id": 1,
        "timestamp": "1970-01-01T00:00:01+00:00",
        "source_ip": "10.0.0.0",
        "event_type": "PORT_SCAN",
        "details": "d",
    }
    assert texts[3]["timestamp"] == "2023-11-14T22:13:20.123456+00:00"
    assert store.alert_lines(log.filter("id = 1")).first().line == "ALERT [PORT_SCAN] source=10.0.0.0 :: d"


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([tuple(alert(1).get(f.name) for f in ALERT_SCHEMA)], ALERT_SCHEMA)
    df = df.withColumn("detector_ordinal", F.lit(0))
    for batch in (0, 1, 1, 2):
        store.append_alerts(df, path, batch)
    assert [r.id for r in store.read_alerts(spark, path).orderBy("id").collect()] == [1, 2, 3]


def test_request_limit():
    cases = {None: 100, 0: 100, "abc": 100, "": 100, "7": 7, 1000: 1000, 5000: 1000, "2.5": 100}
    assert {k: store.request_limit(k) for k in cases} == cases
    for bad in (-1, "-5"):
        with pytest.raises(ValueError):
            store.request_limit(bad)


def test_no_shuffle_files_stay_behind_a_scratch_table(spark):
    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}

    before = shuffle_files()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = scratch.materialize(rows.join(rows.withColumnRenamed("count", "n"), "k").orderBy("k"))
    until = time.time() + 20
    while (left := shuffle_files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and kept.count() == 7
    assert spark.conf.get(name, None) == setting


def test_scratch_tables_go(spark):
    """A scope takes its own tables with it, and the application can drop all of its."""
    rows = spark.range(3)
    kept = scratch.materialize(rows)
    with scratch.scratch_scope(spark):
        inside = scratch.materialize(rows).inputFiles()
    folder = Path(scratch.scratch_dir(spark).removeprefix("file:"))
    names = {p.name for p in folder.iterdir()}
    assert Path(kept.inputFiles()[0]).parent.name in names and Path(inside[0]).parent.name not in names
    own = spark.newSession()
    assert scratch.scratch_dir(own) == scratch.scratch_dir(spark)


def test_ids_of_concurrent_writers(spark, tmp_path):
    """Every alert has an id of its own, whoever appends at the same time."""
    path = str(tmp_path / "log")
    writers = [threading.Thread(target=log_of, args=(spark, path, *[[alert(10 * i + j)] for j in range(3)])) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.id for r in store.read_alerts(spark, path).collect()) == list(range(1, 13))


def test_an_append_reads_no_old_alerts(spark, tmp_path):
    """The log's files can be gone: the next ids are known all the same."""
    path = tmp_path / "log"
    log_of(spark, path, [alert(5), alert(6)], [alert(7)])
    for folder in path.glob("writer=*"):
        folder.rename(tmp_path / folder.name)
    assert [r.id for r in log_of(spark, path, [alert(8)]).collect()] == [4]
