"""What the physical plans must and must not contain."""

from __future__ import annotations

import random
import time

import pytest
from brute import packet, packets_df, windowed
from pyspark.sql import functions as F
from test_detectors import random_packets

from wiretide.operators import chain, detectors, running, slices, windows
from wiretide.operators.predicates import port_scan_eligible, syn_packets
from wiretide.operators.sliding import sliding_count, sliding_distinct_count
from wiretide.operators.whitelist import exclude_whitelisted
from wiretide.plans import engine
from wiretide.plans.store import read_alerts, recent_events
from wiretide.schema import ALERT_SCHEMA
from wiretide.scratch import materialize
from wiretide.sources.packets import as_packets, load_packets, timed


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "packets")
    rows = spark.range(100).select(
        F.col("id").alias("seq"),
        (F.col("id") + 1e9).alias("ts"),
        F.lit("10.0.0.1").alias("src_ip"),
        F.lit("TCP").alias("protocol"),
        F.col("id").cast("int").alias("dst_port"),
        F.lit("S").alias("tcp_flags"),
        F.lit("unused").alias("dst_mac"),
    )
    rows.write.parquet(path)
    return load_packets(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(packets):
    text = plan(syn_packets(packets).select("src_ip", "ts_us", "seq"))
    for pushed in ("EqualTo(protocol,TCP)", "IsNotNull(src_ip)", "IsNotNull(tcp_flags)"):
        assert pushed in text
    assert "dst_mac" not in text.split("ReadSchema")[1].splitlines()[0]
    text = plan(exclude_whitelisted(port_scan_eligible(packets), ["10.0.0.3"]).select("seq"))
    assert "In(protocol, [TCP,UDP])" in text and "IsNotNull(dst_port)" in text


def test_time_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "packets")
    rows = spark.range(100).select(
        F.col("id").alias("seq"), (F.col("id") * 1_000_000).alias("ts_us"), F.lit("10.0.0.1").alias("src_ip"), (F.col("id") % 3).alias("day")
    )
    rows.write.partitionBy("day").parquet(path)
    got = load_packets(spark, path, between=(10_000_000, 20_000_000)).filter("day = 1")
    text = plan(timed(got).select("seq"))
    assert "GreaterThanOrEqual(ts_us,10000000)" in text and "LessThan(ts_us,20000000)" in text
    assert "(day" in text.split("PartitionFilters")[1].splitlines()[0]
    assert sorted(r.seq for r in got.collect()) == [10, 13, 16, 19]
    seconds = str(tmp_path / "seconds")
    rows.withColumn("ts", F.col("ts_us") / 1e6).drop("ts_us").write.parquet(seconds)
    got = load_packets(spark, seconds, between=(10_000_000, 20_000_000))
    assert "GreaterThanOrEqual(ts," in plan(got) and sorted(r.seq for r in got.collect()) == list(range(10, 20))


def test_arrival_numbers_of_a_table_without_them(spark, tmp_path):
    """Dense, in the order of time, whatever the file layout: an early small file after a late large one, many packets of one time."""
    path = str(tmp_path / "packets")
    rows = spark.range(1000).select((F.col("id") - F.col("id") % 50).alias("ts_us"), F.concat(F.lit("10.0.0."), F.col("id") % 9).alias("src_ip"))
    rows = rows.unionByName(spark.range(400).select(F.lit(7000).cast("bigint").alias("ts_us"), F.lit("flood").alias("src_ip")))
    rows.filter("ts_us >= 500").repartition(7).write.parquet(path)
    rows.filter("ts_us < 500").coalesce(1).write.mode("append").parquet(path)
    found = load_packets(spark, path).orderBy("seq").collect()
    assert [r.seq for r in found] == list(range(1400))
    assert [r.ts_us for r in found] == sorted(r.ts_us for r in found)
    # Another layout gives every packet the same number.
    other = str(tmp_path / "other")
    rows.repartition(3, "src_ip").write.parquet(other)
    assert [(r.ts_us, r.src_ip) for r in load_packets(spark, other).orderBy("seq").collect()] == [(r.ts_us, r.src_ip) for r in found]
    some = load_packets(spark, path, between=(500, 600)).collect()
    assert sorted(r.seq for r in some) == list(range(100)) and {r.ts_us for r in some} == {500, 550}


def test_a_flood_of_equal_packets_is_numbered_in_many_tasks(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(running, "materialize", lambda df: tables.append(materialize(df)) or tables[-1])
    rows = spark.range(40_000).select(F.lit(5).cast("bigint").alias("ts_us"), F.lit("a").alias("src_ip"), F.lit(80).alias("dst_port"))
    numbered = as_packets(rows.repartition(6))
    assert numbered.agg(F.countDistinct("seq"), F.max("seq")).first() == (40_000, 39_999)
    sizes = [r["count"] for r in tables[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 20_000


def test_alerts_of_packets_without_arrival_numbers(spark):
    """Whole seconds: every alert lists as many ports as it counts, and no two alerts share an identity."""
    rng = random.Random(7)
    rows = [(float(rng.randrange(60)), f"10.0.0.{rng.randrange(3)}", "TCP", rng.randrange(40), "S") for _ in range(3000)]
    df = as_packets(spark.createDataFrame(rows, "ts double, src_ip string, protocol string, dst_port int, tcp_flags string"))
    scans = detectors.detect_port_scan(df, 10, 5, 0).collect()
    assert len(scans) > 2500 and all(r.observed == len(r["items"]) for r in scans)
    floods = detectors.detect_syn_flood(df, 5, 5, 0).collect()
    assert len(floods) > 2900 and len({(r.source_ip, r.ts_us, r.seq) for r in floods}) == len(floods)


def test_live_ports_of_every_packet(spark):
    """With no cooldown each packet over the threshold alerts: the lists are those written out."""
    rng = random.Random(8)
    rows = [packet(rng.randrange(400) / 4, src_ip=f"s{rng.randrange(2)}", dst_port=rng.randrange(30)) for _ in range(400)]
    rows.sort(key=lambda r: r["ts"])
    keyed = [{**r, "seq": i, "ts_us": round(r["ts"] * 1e6)} for i, r in enumerate(rows)]
    expected = {i: sorted({r["dst_port"] for r in windowed(keyed, i, "src_ip", 6_000_000)}) for i in range(400)}
    found = {r.seq: [int(p) for p in r["items"]] for r in detectors.detect_port_scan(packets_df(spark, rows), 4, 6, 0).collect()}
    assert found == {i: ports for i, ports in expected.items() if len(ports) >= 4}


def test_port_scan_takes_few_jobs(spark, tmp_path):
    path = str(tmp_path / "packets")
    packets_df(spark, random_packets(5)).drop("ts_us", "event_time").write.parquet(path)
    rows = load_packets(spark, path)
    spark.sparkContext.setJobGroup("port scan", "counted")
    try:
        assert detectors.detect_port_scan(rows, 4, 4, 6).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("port scan")) <= 14


def test_detectors_read_the_packets_once(spark, tmp_path, monkeypatch):
    """All intermediate tables of a run: only one of them is made from the packets."""
    path = str(tmp_path / "packets")
    packets_df(spark, random_packets(5)).drop("ts_us", "event_time").write.parquet(path)
    made = []

    def counting(df):
        made.append(any(path in f for f in df.inputFiles()))
        return materialize(df)

    for module in (engine, detectors, chain, slices, windows):
        monkeypatch.setattr(module, "materialize", counting)
    alerts = engine.detect_all(load_packets(spark, path), {"dos": {"syn_threshold": 2}})
    made.append(any(path in f for f in alerts.inputFiles()))
    assert sum(made) == 1 and len(made) > 5


def test_sources_that_cannot_alert_enter_no_window(spark, monkeypatch):
    rows = [packet(i, src_ip=f"s{i % 50}", dst_port=i) for i in range(500)]
    rows += [packet(1000 + i, src_ip="scanner", dst_port=i) for i in range(12)]
    seen = []
    count = detectors.sliding_distinct_count
    monkeypatch.setattr(detectors, "sliding_distinct_count", lambda df, *a, **k: seen.append(df) or count(df, *a, **k))
    alerts = detectors.detect_port_scan(packets_df(spark, rows), 8, 20, 30)
    assert [r.source_ip for r in alerts.collect()] == ["scanner"]
    assert {r.src_ip for r in seen[0].collect()} == {"scanner"}


def test_equal_arrival_numbers_of_two_sources(spark):
    """Sources are told apart even where their arrival numbers are the same."""
    df = packets_df(spark, [packet(1 + i / 10, src_ip=s, dst_port=p + i, src_mac=f"{s}{i}") for i in range(3) for s, p in (("a", 100), ("b", 500))])
    df = df.withColumn("seq", F.floor(F.col("seq") / 2))
    got = detectors.detect_port_scan(df, 3, 10, 30).collect()
    assert {r.source_ip: r["items"] for r in got} == {"a": ["100", "101", "102"], "b": ["500", "501", "502"]}
    spoofs = detectors.detect_arp_spoof(df.withColumn("is_arp", F.lit(True)), 60).collect()
    assert sorted((r.source_ip, r["items"]) for r in spoofs) == [
        (s, [f"{s}{k}" for k in range(n)]) for s in "ab" for n in (2, 3)
    ]


def test_a_key_whose_rows_all_fire(spark):
    """The pass over a key is linear: 40,000 rows that all fire take seconds at most."""
    df = spark.range(40_000).select(F.lit("k").alias("src_ip"), (F.col("id") * 10).alias("ts_us"), F.col("id").alias("seq"))
    assert chain.cooldown(df, "src_ip", 1).count() == 40_000
    started = time.perf_counter()
    assert chain.cooldown(df, "src_ip", 1).count() == 40_000
    assert time.perf_counter() - started < 8


def test_a_hot_key_with_few_gaps_is_never_grouped(spark, monkeypatch):
    """A long gap over a short history: each step is a combining aggregate, and no Python group holds the key."""
    for name in ("_lift_span", "_expand_span", "_fold"):
        monkeypatch.setattr(chain, name, None)
    df = spark.range(200_000).select(F.lit("k").alias("src_ip"), (F.col("id") * 13).alias("ts_us"), F.col("id").alias("seq"))
    got = chain.cooldown(df, "src_ip", 600_000, fold_rows=1000).orderBy("seq").collect()
    times, opens = [], 0
    for t in range(0, 200_000 * 13, 13):
        if t >= opens:
            times.append(t)
            opens = t + 600_000
    assert [r.ts_us for r in got] == times and len(times) == 5


@pytest.mark.parametrize("kernel", ["count", "distinct"])
def test_short_windows_take_one_shuffle_and_no_python(packets, kernel):
    rows = packets.select("src_ip", "dst_port", "ts_us", "seq")
    if kernel == "count":
        text = plan(sliding_count(rows, "src_ip", 10))
        assert text.count("+- Sort [") == 1
    else:
        text = plan(sliding_distinct_count(rows, "src_ip", "dst_port", 10))
    assert text.count("Exchange hashpartitioning(src_ip") == 1
    assert text.count("Exchange") == 1
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    # The expired part is a growing frame, which Spark extends in place.
    assert "RangeFrame, unboundedpreceding$(), -10000001" in text


@pytest.mark.parametrize("slice_s", [None, 2.0])
def test_windows_are_partitioned_by_key_and_slice(packets, slice_s):
    text = plan(sliding_count(packets.select("src_ip", "ts_us", "seq"), "src_ip", 10, slice_s))
    for line in text.splitlines():
        if "windowspecdefinition(src_ip" in line and "_at" in line:
            assert "_slice" in line.split("windowspecdefinition(")[1]


def test_recent_events_keep_only_the_top_rows(spark, tmp_path):
    df = spark.createDataFrame([], ALERT_SCHEMA).withColumn("id", F.lit(1).cast("bigint"))
    df.write.parquet(str(tmp_path / "log" / "writer=w" / "batch_id=0" / "event_date=2024-01-01"))
    text = plan(recent_events(read_alerts(spark, str(tmp_path / "log"))))
    assert "TakeOrderedAndProject" in text
