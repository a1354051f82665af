"""The registered queries: every operator over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import iso_utc, slice_start
from ..operators.chain import cooldown
from ..operators.detectors import (
    detect_arp_spoof,
    detect_port_scan,
    detect_syn_flood,
    detect_traffic_anomaly,
)
from ..operators.distinct import HOUR_US, cumulative_distinct
from ..operators.predicates import arp_eligible, port_scan_eligible, syn_packets
from ..operators.sliding import sliding_count, sliding_distinct_count
from ..operators.whitelist import exclude_whitelisted
from ..operators.windows import (
    aligned_windows,
    anchored_windows,
    assign_windows,
    rolling_baseline,
    top_source_per_window,
    window_starts,
)
from ..schema import PACKET_COLUMNS
from ..scratch import materialize, scratch_path
from ..session import STATE_STORE
from ..sources.events import DETECTOR_SETTINGS, event_frames, event_packets
from ..sources.frames import capture_filter, decode_frames, split_malformed
from ..sources.packets import as_packets, load_packets
from ..streaming.streams import (
    TrafficAnomalyStream,
    start_alert_sink,
    start_detect_all,
    stream_detect,
    stream_failures,
    stream_summary,
)
from . import store
from .engine import (
    assign_ids,
    detect_all,
    detect_isolated,
    register_detector,
    session_summary,
    unregister_detector,
)

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400
SCAN = DETECTOR_SETTINGS["port_scan"]
FLOOD = DETECTOR_SETTINGS["dos"]
ANOMALY = DETECTOR_SETTINGS["traffic_anomaly"]
TRUSTED = ["10.0.0.3", "10.0.0.8/30", "2001:db8::/32"]
SHORT_WINDOW_S = 6 * 3600
# Half of the packets each: thresholds that still alert.
SENSOR_SETTINGS = {**DETECTOR_SETTINGS, "port_scan": {**SCAN, "port_threshold": 5}, "dos": {**FLOOD, "syn_threshold": 4}}
LATENESS_S = DAY
# Ten days of the given events, in microseconds.
RANGE = (1_704_844_800_000_000, 1_705_708_800_000_000)

# Alerts are compared on numbers and text; the alert time as microseconds and as ISO text.
ALERT_VIEW = ["seq", "ts_us", "source_ip", "event_type", "observed", "details"]


def _view(alerts: DataFrame, *extra: str) -> DataFrame:
    return alerts.select(*ALERT_VIEW, *extra)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table, written out and read back through the packet source."""
    path = scratch_path(spark)
    event_packets(spark, sf_dir).write.parquet(path)
    return load_packets(spark, path).select(
        "seq", "ts_us", iso_utc(F.col("ts_us")).alias("event_time"), "src_ip", "src_mac", "protocol", "dst_port",
        "tcp_flags", "is_arp", "length",
    )


DECODED = ["seq", "src_ip", "dst_ip", "src_mac", "dst_mac", "protocol", "src_port", "dst_port", "tcp_flags", "is_arp", "arp_op", "length"]


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table ``seq, ts, frame`` with one raw frame per event."""
    return materialize(event_frames(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = split_malformed(decode_frames(frame_table(spark, sf_dir)))
    return good.select(*DECODED)


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_filter(frame_table(spark, sf_dir)).select("seq", F.length("frame").alias("length"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = split_malformed(decode_frames(frame_table(spark, sf_dir)))
    return bad.select("seq", F.length("frame").alias("length"), "decode_error")


def syn_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = syn_packets(event_packets(spark, sf_dir)).select("src_ip", "ts_us", "seq")
    return sliding_count(syn, "src_ip", FLOOD["time_window"])


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets in whole hours and without arrival numbers, so that many share a time."""
    rows = event_packets(spark, sf_dir).select(*[c for c in PACKET_COLUMNS if c not in ("seq", "ts", "event_time")])
    return as_packets(rows.withColumn("ts_us", slice_start(F.col("ts_us"), HOUR_US)))


def arrival_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unnumbered(spark, sf_dir).groupBy("ts_us")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("seq").alias("numbers")
    )


def unnumbered_port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each source alerts, and whether every alert lists as many ports as it counts."""
    found = detect_port_scan(unnumbered(spark, sf_dir), SCAN["port_threshold"], SCAN["time_window"], SCAN["cooldown"])
    return found.select("source_ip", "ts_us", (F.col("observed") == F.size("items")).alias("listed"))


def port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_port_scan(event_packets(spark, sf_dir), SCAN["port_threshold"], SCAN["time_window"], SCAN["cooldown"])


def arp_spoof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_arp_spoof(event_packets(spark, sf_dir), DETECTOR_SETTINGS["arp_spoof"]["cooldown"])


def syn_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_syn_flood(event_packets(spark, sf_dir), FLOOD["syn_threshold"], FLOOD["time_window"], FLOOD["cooldown"])


def traffic_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_traffic_anomaly(event_packets(spark, sf_dir), *_anomaly_settings())


def _anomaly_settings() -> tuple:
    return tuple(ANOMALY[k] for k in ("window_seconds", "baseline_windows", "multiplier", "min_baseline_samples"))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_packets(spark, sf_dir).select("seq", "ts_us", "src_ip")
    starts = window_starts(rows, ANOMALY["window_seconds"])
    return top_source_per_window(assign_windows(rows, starts, ANOMALY["window_seconds"]))


def whitelisted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(detect_all(event_packets(spark, sf_dir), DETECTOR_SETTINGS, whitelist=TRUSTED))


def fault_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-detector status of a run in which one detector fails."""

    def broken(packets: DataFrame, _settings) -> DataFrame:
        return detect_syn_flood(packets.withColumn("ts_us", F.raise_error(F.lit("broken")).cast("bigint")))

    register_detector("broken", broken)
    try:
        alerts, statuses = detect_isolated(
            event_packets(spark, sf_dir), DETECTOR_SETTINGS, ["port_scan", "broken", "dos"]
        )
    finally:
        unregister_detector("broken")
    failed = [s.detector for s in statuses if not s.ok]
    return alerts.groupBy("event_type").agg(F.count(F.lit(1)).alias("alerts")).withColumn(
        "failed_detectors", F.lit(",".join(failed))
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_packets(spark, sf_dir)
    return session_summary(rows, detect_all(rows, DETECTOR_SETTINGS, whitelist=TRUSTED))


def detect_by_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors in one table, told apart by the destination port."""
    rows = event_packets(spark, sf_dir).withColumn("sensor_id", F.col("dst_port") % 2)
    return _view(detect_all(rows, SENSOR_SETTINGS, sensor="sensor_id"), "sensor_id")


_LOGS: dict[tuple[str, str], str] = {}


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert log of a full run, appended in two batches; written once per session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _LOGS:
        path = scratch_path(spark)
        rows = event_packets(spark, sf_dir)
        store.append_alerts(detect_all(rows, DETECTOR_SETTINGS, ["port_scan", "dos"]), path)
        store.append_alerts(detect_all(rows, DETECTOR_SETTINGS, "arp_spoof, traffic_anomaly"), path)
        _LOGS[known] = path
    return store.read_alerts(spark, _LOGS[known])


def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines of a full run, read back from the text files."""
    path = scratch_path(spark)
    store.append_alerts(detect_all(event_packets(spark, sf_dir), DETECTOR_SETTINGS), f"{path}/log", lines_path=f"{path}/lines")
    return spark.read.text(f"{path}/lines").select(F.col("value").alias("line"))


def newest(spark: SparkSession, sf_dir: str, *options) -> DataFrame:
    alert_log(spark, sf_dir)
    return _log_view(store.newest_events(spark, _LOGS[spark.sparkContext.applicationId, sf_dir], *options))


def _log_view(log: DataFrame) -> DataFrame:
    return log.select("id", *ALERT_VIEW)


BATCHES, FILES = 3, 4
# Packets of a micro-batch that are worth a file of their own beyond the first ``FILES``.
FILE_ROWS = 50_000


def _in_batches(rows: DataFrame, part: Column) -> DataFrame:
    """A stream over files in ``BATCHES`` groups, one group per micro-batch, dealt by ``part`` (0, 1, ...).

    A group has ``FILES`` files, or as many as the session has cores if all groups are large, so that they are written and read side by side.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession)
    rows = materialize(rows.withColumn("_part", part))
    sizes = rows.groupBy("_part").count().select(F.min("count"), F.count(F.lit(1))).first()
    smallest = sizes[0] if sizes[1] >= BATCHES else 0
    files = max(FILES, min(2 * spark.sparkContext.defaultParallelism, smallest // FILE_ROWS))
    for i in range(BATCHES):
        rows.filter(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(path)
    return load_packets(spark, path, streaming=True, maxFilesPerTrigger=str(files))


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a replay: keyed state needs RocksDB, and one state store per shuffle partition."""
    own = spark.newSession()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return own


def _stream_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets in the order of arrival."""
    rows = event_packets(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0]
    return _in_batches(rows, F.floor(F.col("seq") * BATCHES / F.lit(last + 1)))


def _late_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets, up to ``LATENESS_S`` late; one more far behind the others lets the watermark pass them all."""
    rows = event_packets(spark, sf_dir)
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    delay = F.pmod(F.xxhash64("seq"), F.lit(LATENESS_S * 1_000_000))
    part = F.floor((F.col("ts_us") + delay - F.lit(low)) * BATCHES / F.lit(high - low + LATENESS_S * 1_000_000 + 1))
    after = F.lit(high + 2 * LATENESS_S * 1_000_000)
    last = {"seq": F.col("seq") + 1, "ts_us": after, "ts": after / F.lit(1e6), "event_time": F.timestamp_micros(after), "src_ip": F.lit("0.0.0.1")}
    flags = {"protocol": F.lit("TCP"), "dst_port": F.lit(1), "tcp_flags": F.lit("S"), "is_arp": F.lit(True), "src_mac": F.lit("m")}
    closing = rows.orderBy(F.desc("seq")).limit(1).withColumns({**last, **flags})
    dealt = rows.withColumn("_at", part).unionByName(closing.withColumn("_at", F.lit(BATCHES - 1).cast("bigint")))
    return _in_batches(dealt, F.col("_at"))


def _replay(spark: SparkSession, sf_dir: str, detector: str, late: bool = False, **params) -> DataFrame:
    path = scratch_path(spark)
    own = _stream_session(spark)
    if late:
        alerts = stream_detect(_late_input(own, sf_dir), detector, watermark=f"{LATENESS_S} seconds", **params)
    else:
        alerts = stream_detect(_stream_input(own, sf_dir), detector, **params)
    start_alert_sink(alerts, f"{path}/log", f"{path}/checkpoint", available_now=True).awaitTermination()
    return _view(store.read_alerts(spark, f"{path}/log"))


def _run_stream(spark: SparkSession, sf_dir: str, late: bool = False, **options) -> str:
    """A replay of all packets through ``start_detect_all``; returns the folder of its ``log`` and ``state``."""
    path, own = scratch_path(spark), _stream_session(spark)
    rows = _late_input(own, sf_dir) if late else _stream_input(own, sf_dir)
    lateness = LATENESS_S if late else None
    args = (f"{path}/log", f"{path}/checkpoint", f"{path}/state", DETECTOR_SETTINGS)
    start_detect_all(rows, *args, available_now=True, lateness_s=lateness, **options).awaitTermination()
    return path


def stream_port_scan(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    return _view(store.read_alerts(spark, f"{_run_stream(spark, sf_dir, late, enabled='port_scan')}/log"))


def stream_arp_spoof(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    return _replay(spark, sf_dir, "arp_spoof", late, cooldown_s=DETECTOR_SETTINGS["arp_spoof"]["cooldown"])


def stream_syn_flood(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    return _view(store.read_alerts(spark, f"{_run_stream(spark, sf_dir, late, enabled='dos')}/log"))


def stream_traffic_anomaly(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    path, own = scratch_path(spark), _stream_session(spark)
    stream = TrafficAnomalyStream(f"{path}/log", f"{path}/state", *_anomaly_settings(), lateness_s=LATENESS_S if late else None)
    rows = _late_input(own, sf_dir) if late else _stream_input(own, sf_dir)
    stream.start(rows, f"{path}/checkpoint", available_now=True).awaitTermination()
    return _view(store.read_alerts(spark, f"{path}/log"))


def stream_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_view(store.read_alerts(spark, f"{_run_stream(spark, sf_dir)}/log"))


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_summary(spark, f"{_run_stream(spark, sf_dir, whitelist=TRUSTED)}/state")


def stream_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream in which one detector always fails, and the micro-batches in which it did."""

    def broken(packets: DataFrame, _settings, _memory=None) -> DataFrame:
        return detect_syn_flood(packets.withColumn("ts_us", F.raise_error(F.lit("broken")).cast("bigint")))

    register_detector("broken", broken, stream=broken)
    try:
        path = _run_stream(spark, sf_dir, enabled=["port_scan", "broken", "dos"])
    finally:
        unregister_detector("broken")
    failed = stream_failures(spark, f"{path}/state").agg(F.count(F.lit(1)).alias("failures"), F.max("detector").alias("failed_detectors"))
    failures, names = failed.first()
    by_type = store.read_alerts(spark, f"{path}/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("alerts"))
    return by_type.withColumn("failures", F.lit(failures).cast("bigint")).withColumn("failed_detectors", F.lit(names))


def windows_of_the_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned windows of a stream; the packet that moves the watermark past the others is in none that is given."""
    path, own = scratch_path(spark), _stream_session(spark)
    counted = aligned_windows(_late_input(own, sf_dir), SHORT_WINDOW_S, f"{LATENESS_S} seconds")
    sink = counted.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
    sink.trigger(availableNow=True).start(f"{path}/windows").awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{path}/windows")


def packets_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    event_packets(spark, sf_dir).write.parquet(path)
    return load_packets(spark, path, between=RANGE).select("seq", "ts_us", "src_ip")


def _counted(spark: SparkSession, sf_dir: str, window_s: int) -> DataFrame:
    syn = syn_packets(event_packets(spark, sf_dir)).select("src_ip", "ts_us", "seq")
    return sliding_count(syn, "src_ip", window_s)


def _distinct(spark: SparkSession, sf_dir: str, window_s: int) -> DataFrame:
    eligible = port_scan_eligible(event_packets(spark, sf_dir)).select("src_ip", "dst_port", "ts_us", "seq")
    return sliding_distinct_count(eligible, "src_ip", "dst_port", window_s).select("seq", "src_ip", "ts_us", "observed")


def arp_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arp_eligible(event_packets(spark, sf_dir)).select("src_ip", "src_mac", "ts_us", "seq")
    return cumulative_distinct(rows, "src_ip", "src_mac", DAY)


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = syn_over(spark, sf_dir).filter(F.col("observed") >= FLOOD["syn_threshold"])
    return cooldown(over, "src_ip", FLOOD["cooldown"] * 1_000_000).select("seq", "src_ip", "ts_us", "observed")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchored_windows(event_packets(spark, sf_dir).select("seq", "ts_us"), ANOMALY["window_seconds"])


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return store.stats(alert_log(spark, sf_dir)).select("total_events", F.array_join(by_type, ",").alias("by_type"))


QUERIES: dict[str, Query] = {
    "packets": packets,
    "decode_frames": frames,
    "capture_filter": captured,
    "quarantine": quarantine,
    "syn_packets": lambda s, d: syn_packets(event_packets(s, d)).select("seq", "src_ip", "tcp_flags"),
    "port_scan_eligible": lambda s, d: port_scan_eligible(event_packets(s, d)).select("seq", "src_ip", "protocol", "dst_port"),
    "arp_eligible": lambda s, d: arp_eligible(event_packets(s, d)).select("seq", "src_ip", "src_mac"),
    "whitelist_filter": lambda s, d: exclude_whitelisted(event_packets(s, d), TRUSTED).select("seq", "src_ip"),
    "sliding_syn_count": lambda s, d: _counted(s, d, SHORT_WINDOW_S),
    "sliding_syn_count_3d": lambda s, d: _counted(s, d, FLOOD["time_window"]),
    "sliding_distinct_ports": lambda s, d: _distinct(s, d, SHORT_WINDOW_S),
    "sliding_distinct_ports_3d": lambda s, d: _distinct(s, d, SCAN["time_window"]),
    "arp_bindings": arp_bindings,
    "cooldown": fired,
    "anchored_windows": _windows,
    "rolling_baseline": lambda s, d: rolling_baseline(_windows(s, d), ANOMALY["baseline_windows"]).select(
        "window_id", "window_start", "n", "baseline_avg", "baseline_n"
    ),
    "top_source_per_window": top_sources,
    "port_scan": lambda s, d: _view(port_scan(s, d)),
    "arp_spoof": lambda s, d: _view(arp_spoof(s, d)),
    "syn_flood": lambda s, d: _view(syn_flood(s, d), "rate"),
    "traffic_anomaly": lambda s, d: _view(traffic_anomaly(s, d), "threshold"),
    "selected_detectors": lambda s, d: _view(
        detect_all(event_packets(s, d), DETECTOR_SETTINGS, enabled=["dos", "port_scan"]), "detector_ordinal"
    ),
    "detect_all": lambda s, d: _view(detect_all(event_packets(s, d), DETECTOR_SETTINGS)),
    "detect_all_whitelisted": whitelisted_run,
    "alert_ids": lambda s, d: assign_ids(detect_all(event_packets(s, d), DETECTOR_SETTINGS)).select("id", "seq", "event_type"),
    "fault_isolation": fault_isolation,
    "session_summary": summary,
    "alert_log": lambda s, d: _log_view(alert_log(s, d)),
    "alert_lines": lambda s, d: store.alert_lines(alert_log(s, d)).select("id", "line"),
    "alert_text": alert_text,
    "events_by_type": lambda s, d: _log_view(store.filter_alerts(alert_log(s, d), event_type="SYN_FLOOD")),
    "events_by_source": lambda s, d: _log_view(store.filter_alerts(alert_log(s, d), source_ip="10.0.0.7")),
    "recent_events": lambda s, d: _log_view(store.recent_events(alert_log(s, d))),
    "recent_events_filtered": lambda s, d: _log_view(store.recent_events(alert_log(s, d), 5, "ARP_SPOOF", "10.0.0.7")),
    "recent_events_capped": lambda s, d: _log_view(store.recent_events(alert_log(s, d), 5000, capped=True)),
    "newest_events": newest,
    "newest_events_filtered": lambda s, d: newest(s, d, 5, "ARP_SPOOF", "10.0.0.7"),
    "event_count": lambda s, d: store.event_count(alert_log(s, d)),
    "events_per_type": lambda s, d: store.events_per_type(alert_log(s, d)),
    "stats": _stats,
    "events_json": lambda s, d: store.alerts_json(alert_log(s, d)).select("id", "json"),
    "type_cards": lambda s, d: store.type_cards(alert_log(s, d)),
    "stream_port_scan": stream_port_scan,
    "stream_arp_spoof": stream_arp_spoof,
    "stream_syn_flood": stream_syn_flood,
    "stream_traffic_anomaly": stream_traffic_anomaly,
    "stream_port_scan_late": lambda s, d: stream_port_scan(s, d, late=True),
    "stream_arp_spoof_late": lambda s, d: stream_arp_spoof(s, d, late=True),
    "stream_syn_flood_late": lambda s, d: stream_syn_flood(s, d, late=True),
    "stream_traffic_anomaly_late": lambda s, d: stream_traffic_anomaly(s, d, late=True),
    "stream_detect_all": stream_detect_all,
    "stream_summary": stream_totals,
    "stream_fault_isolation": stream_isolation,
    "aligned_windows": windows_of_the_grid,
    "detect_by_sensor": detect_by_sensor,
    "packets_in_range": packets_in_range,
    "arrival_numbers": arrival_numbers,
    "unnumbered_port_scan": unnumbered_port_scan,
}
