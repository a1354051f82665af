"""Streaming detection and the alert sink."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timing import cooldown_us, window_us
from ..operators.detectors import (
    arp_spoof_alerts,
    port_scan_alerts,
    syn_flood_alerts,
)
from ..operators.predicates import arp_eligible, port_scan_eligible, syn_packets
from ..operators.whitelist import exclude_whitelisted
from ..plans.engine import WATCHED_COLUMNS, all_sections, detector_names, is_built_in, select_detectors, stream_form
from ..plans.store import append_alerts, stream_writer
from ..schema import ALERT_SCHEMA, PACKET_COLUMNS
from ..scratch import materialize, scratch_scope
from .memory import Folder, StreamMemory
from .processors import FIRED_SCHEMA, ArpSpoofProcessor, PerSourceProcessor, PortScanProcessor, SynFloodProcessor
from .steps import port_scan_step, syn_flood_step
from .traffic import hold_back, traffic_step

logger = logging.getLogger("wiretide")

KEYED_DETECTORS = ("port_scan", "arp_spoof", "dos")
# Groups of sources in keyed state; part of a stream's checkpoint.
SOURCE_BUCKETS = 512


def stream_detect(packets: DataFrame, detector: str, watermark: str | None = None, **params) -> DataFrame:
    """A stream of alerts from a stream of packets, for the detectors that are keyed by source.

    Parameters are those of the batch detectors. With ``watermark`` (such as
    ``"1 minute"``) packets are held back that long and folded in the order of time; later ones are dropped, and Spark reports
    how many. Without it every packet counts when it arrives.
    """
    time_mode = "None"
    time: list[str] = []
    if watermark is not None:
        packets, time, time_mode = packets.withWatermark("event_time", watermark), ["event_time"], "EventTime"
    gap = cooldown_us(params.get("cooldown_s", 60.0 if detector == "arp_spoof" else 30.0))
    if detector == "port_scan":
        threshold, window_s = params.get("port_threshold", 15), params.get("window_s", 10.0)
        rows = port_scan_eligible(packets).select("src_ip", "dst_port", "ts_us", "seq", *time)
        fired = _fold_per_source(rows, PortScanProcessor(threshold, window_us(window_s), gap), time_mode)
        return port_scan_alerts(fired, threshold, window_s)
    if detector == "dos":
        threshold, window_s = params.get("syn_threshold", 100), params.get("window_s", 5.0)
        rows = syn_packets(packets).select("src_ip", "ts_us", "seq", *time)
        fired = _fold_per_source(rows, SynFloodProcessor(threshold, window_us(window_s), gap), time_mode)
        return syn_flood_alerts(fired, threshold, window_s)
    if detector == "arp_spoof":
        ttl_ms = params.get("ttl_ms")
        if ttl_ms is not None:
            if watermark is not None:
                raise ValueError("ttl_ms works on processing time and cannot be used with a watermark")
            time_mode = "ProcessingTime"
        rows = arp_eligible(packets).select("src_ip", "src_mac", "ts_us", "seq", *time)
        return arp_spoof_alerts(_fold_per_source(rows, ArpSpoofProcessor(gap, ttl_ms), time_mode))
    raise ValueError(f"{detector!r} is not keyed by source; expected one of {list(KEYED_DETECTORS)}")


def _fold_per_source(rows: DataFrame, processor: PerSourceProcessor, time_mode: str) -> DataFrame:
    processor.event_time = time_mode == "EventTime"
    bucket = F.pmod(F.xxhash64("src_ip"), F.lit(SOURCE_BUCKETS)).cast("int").alias("_bucket")
    return rows.select("*", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=FIRED_SCHEMA, outputMode="Append", timeMode=time_mode
    )


def start_alert_sink(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends a stream of alerts to the log at ``path``; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = stream_writer(batch.sparkSession, checkpoint)
        append_alerts(batch.withColumn("detector_ordinal", F.lit(0)), path, batch_id, writer)

    return _start(alerts, write, checkpoint, available_now)


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    def write_and_clear(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            write(batch, batch_id)

    writer = stream.writeStream.foreachBatch(write_and_clear).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class TrafficAnomalyStream:
    """Traffic anomalies over a stream, with the batch operators on each micro-batch (see ``traffic``).

    Without ``lateness_s`` a late packet counts in the window that is open when it arrives and moves no window. With it, packets are
    held back that long and taken in the order of time; later ones are dropped, and ``late`` counts them.
    """

    def __init__(
        self,
        path: str,
        state_path: str,
        window_s: float = 10.0,
        baseline_windows: int = 6,
        multiplier: float = 3.0,
        min_samples: int = 3,
        whitelist: Iterable[str] = (),
        lateness_s: float | None = None,
    ) -> None:
        self.path, self.state_path = path, state_path
        self.settings = {
            "window_seconds": window_s,
            "baseline_windows": baseline_windows,
            "multiplier": multiplier,
            "min_baseline_samples": min_samples,
        }
        self.whitelist = list(whitelist)
        self.lateness = None if lateness_s is None else cooldown_us(lateness_s)

    def start(self, packets: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        rows = exclude_whitelisted(packets, self.whitelist).select("seq", "ts_us", "src_ip")

        def write(batch: DataFrame, batch_id: int) -> None:
            alerts = self.alerts(batch, batch_id).withColumn("detector_ordinal", F.lit(0))
            append_alerts(alerts, self.path, batch_id, stream_writer(batch.sparkSession, checkpoint))

        return _start(rows, write, checkpoint, available_now)

    def late(self, spark: SparkSession, batch_id: int) -> int:
        """Packets dropped up to this batch."""
        return StreamMemory(spark, self.state_path, batch_id + 1, True).read("marks", "taken_us bigint, late bigint").first().late

    def alerts(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The alerts of one micro-batch (seq, ts_us, src_ip); saves what the next one needs."""
        memory = StreamMemory(batch.sparkSession, self.state_path, batch_id, self.lateness is not None)
        batch = materialize(batch)
        if self.lateness is not None:
            batch = hold_back(batch, self.lateness, memory)
        alerts = traffic_step(batch, self.settings, memory)
        memory.finish()
        return alerts


# Steps of the built-in detectors; the bindings of ARP are kept by a stateful operator of the stream.
_STEPS = {"port_scan": port_scan_step, "dos": syn_flood_step, "traffic_anomaly": traffic_step}
_TOTALS = "packets bigint, alerts bigint"
_MARKS = "taken_us bigint, late bigint"
_FAILURES = "batch_id bigint, detector string, error string"


def start_detect_all(
    packets: DataFrame,
    path: str,
    checkpoint: str,
    state_path: str,
    params: Mapping[str, Any] | None = None,
    enabled: Iterable[str] | str | None = None,
    whitelist: Iterable[str] = (),
    available_now: bool = False,
    lateness_s: float | None = None,
    lines_path: str | None = None,
) -> StreamingQuery:
    """All selected detectors over one stream into one log, as ``detect_all`` on a table, and with ``lines_path`` as lines of text, too.

    Each micro-batch goes to every detector in turn, and their alerts are appended together, numbered by (arrival, detector).
    Whitelisted packets enter no detector. With ``lateness_s`` packets are held back that long and given on in the order of time; later ones are
    dropped and counted. A detector that fails is logged; the others go on, and it gets the rows again with the next micro-batch.
    ``stream_summary`` and ``stream_failures`` read what is written beside the state. Own detectors need a stream form
    (``register_detector``).
    """
    names = select_detectors(params, enabled)
    forms = {n: stream_form(n) or (_STEPS.get(n) if is_built_in(n) else None) for n in names}
    stateful = "arp_spoof" in names and forms["arp_spoof"] is None and is_built_in("arp_spoof")
    missing = [n for n in names if forms[n] is None and not (n == "arp_spoof" and stateful)]
    if missing:
        raise ValueError(f"no streaming form of {missing}")
    sections = all_sections(params)
    entries = list(whitelist) or sections["whitelist"]
    columns = WATCHED_COLUMNS if all(forms[n] in (None, _STEPS.get(n)) for n in names) else PACKET_COLUMNS
    alert_type = ALERT_SCHEMA.simpleString()
    parts = [packets.select(F.lit(None).cast(alert_type).alias("alert"), *columns)]
    if stateful:
        watermark = None if lateness_s is None else f"{lateness_s} seconds"
        found = stream_detect(exclude_whitelisted(packets, entries), "arp_spoof", watermark, cooldown_s=sections["arp_spoof"]["cooldown"])
        alert = F.struct(*ALERT_SCHEMA.names).cast(alert_type).alias("alert")
        no_packet = [F.lit(None).cast(packets.schema[c].dataType).alias(c) for c in columns]
        parts.append(found.select(alert, *no_packet))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, materialize(batch)
        ordinal = lambda name: F.lit(detector_names().index(name)).alias("detector_ordinal")
        found = [batch.filter("alert IS NOT NULL").select("alert.*", ordinal("arp_spoof") if stateful else F.lit(0).alias("detector_ordinal"))]
        rows = batch.filter("alert IS NULL").select(*columns)
        memory = StreamMemory(spark, f"{state_path}/stream", batch_id, lateness_s is not None)
        arrived = rows.count()
        # What is read below is one scan of a written table: the micro-batch, its rows held back, or those left of a whitelist.
        if entries:
            rows = exclude_whitelisted(rows, entries)
        if lateness_s is not None:
            rows = hold_back(rows, cooldown_us(lateness_s), memory)
        elif entries:
            rows = materialize(rows)
        failures = []
        for name in names:
            if forms[name] is None:
                continue
            own = StreamMemory(spark, f"{state_path}/{name}", batch_id, lateness_s is not None)
            try:
                alerts = forms[name](own.with_rows_set_aside(rows), sections.get(name, {}), own)
                found.append(materialize(alerts.select(*ALERT_SCHEMA.names, ordinal(name))))
                own.finish()
            except Exception as error:  # any failure of one detector must leave the others running
                logger.exception("detector %s failed in micro-batch %s", name, batch_id)
                own.set_aside(rows)
                failures.append((batch_id, name, f"{type(error).__name__}: {error}"))
        raised = append_alerts(reduce(DataFrame.unionByName, found), path, batch_id, stream_writer(spark, checkpoint), lines_path)
        if failures:
            table = spark.createDataFrame(failures, _FAILURES).drop("batch_id").coalesce(1)
            table.write.mode("overwrite").parquet(f"{state_path}/failures/batch={batch_id}")
        before = memory.read("totals", _TOTALS).first() or (0, 0)
        memory.write("totals", spark.createDataFrame([(before[0] + arrived, before[1] + raised)], _TOTALS).coalesce(1))
        memory.finish()

    return _start(reduce(DataFrame.unionByName, parts), write, checkpoint, available_now)


def stream_summary(spark: SparkSession, state_path: str) -> DataFrame:
    """One row for a stream of ``start_detect_all``: packets that arrived (whitelisted ones included), alerts raised, packets dropped as late."""
    memory = StreamMemory(spark, f"{state_path}/stream", 1 << 62, True)
    packets, alerts = memory.read("totals", _TOTALS).first() or (0, 0)
    marks = memory.read("marks", _MARKS).first()
    return spark.createDataFrame([(packets, alerts, marks.late if marks else 0)], "packets bigint, alerts bigint, late bigint")


def stream_failures(spark: SparkSession, state_path: str) -> DataFrame:
    """The micro-batches in which a detector failed: batch_id, detector, error."""
    if not Folder(spark, f"{state_path}/failures").batches():
        return spark.createDataFrame([], _FAILURES)
    found = spark.read.schema("detector string, error string, batch bigint").parquet(f"{state_path}/failures")
    return found.select(F.col("batch").alias("batch_id"), "detector", "error")
