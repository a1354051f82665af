"""Detector selection, fan-out over one packet table, alert numbering and session totals."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import (
    detect_arp_spoof,
    detect_port_scan,
    detect_syn_flood,
    detect_traffic_anomaly,
)
from ..functions.timing import slice_start
from ..operators.running import dense_index
from ..operators.whitelist import exclude_whitelisted
from ..schema import ALERT_SCHEMA
from ..scratch import materialize
from ..sources.packets import timed
from .params import settings

logger = logging.getLogger("wiretide")

# A detector takes packets and its settings section and returns alerts (``schema.ALERT_SCHEMA``).
Detector = Callable[[DataFrame, Mapping[str, Any]], DataFrame]

# Packets per numbering chunk. A packet raises at most one alert per detector.
_ID_CHUNK = 1 << 20

_REGISTRY: dict[str, Detector] = {
    "port_scan": lambda packets, p: detect_port_scan(packets, p["port_threshold"], p["time_window"], p["cooldown"], by=p.get("by")),
    "arp_spoof": lambda packets, p: detect_arp_spoof(packets, p["cooldown"], by=p.get("by")),
    "dos": lambda packets, p: detect_syn_flood(packets, p["syn_threshold"], p["time_window"], p["cooldown"], by=p.get("by")),
    "traffic_anomaly": lambda packets, p: detect_traffic_anomaly(
        packets, p["window_seconds"], p["baseline_windows"], p["multiplier"], p["min_baseline_samples"], p.get("by")
    ),
}

BUILT_IN = dict(_REGISTRY)

# A stream form takes a micro-batch of packets, the settings section and a ``streaming.memory.StreamMemory`` and returns alerts.
StreamForm = Callable[[DataFrame, Mapping[str, Any], Any], DataFrame]
_STREAM_FORMS: dict[str, StreamForm] = {}

# All that the built-in detectors use.
WATCHED_COLUMNS = ["seq", "ts_us", "src_ip", "src_mac", "protocol", "dst_port", "tcp_flags", "is_arp"]


def register_detector(name: str, detector: Detector, stream: StreamForm | None = None) -> None:
    """Adds a detector after the existing ones; an existing name is replaced in place. ``stream`` is its form for micro-batches."""
    _REGISTRY[name] = detector
    _STREAM_FORMS.pop(name, None)
    if stream is not None:
        _STREAM_FORMS[name] = stream


def unregister_detector(name: str) -> None:
    _REGISTRY.pop(name, None)
    _STREAM_FORMS.pop(name, None)


def is_built_in(name: str) -> bool:
    return name in BUILT_IN and _REGISTRY.get(name) is BUILT_IN[name]


def stream_form(name: str) -> StreamForm | None:
    """The form that a detector was registered with."""
    return _STREAM_FORMS.get(name)


def detector_names() -> list[str]:
    return list(_REGISTRY)


def select_detectors(params: Mapping[str, Any] | None = None, enabled: Iterable[str] | str | None = None) -> list[str]:
    """Names to run, in registry order.

    Explicit names (a list or a comma-separated text) override every ``enabled``
    setting. An unknown name or an empty text is an error.
    """
    if isinstance(enabled, str):
        enabled = [name.strip() for name in enabled.split(",") if name.strip()]
        if not enabled:
            raise ValueError("no detector named")
    if enabled is not None:
        wanted = set(enabled)
        unknown = sorted(wanted - set(_REGISTRY))
        if unknown:
            raise ValueError(f"unknown detectors {unknown}; valid names are {detector_names()}")
        return [name for name in _REGISTRY if name in wanted]
    chosen = settings(params)
    return [name for name in _REGISTRY if chosen.get(name, {}).get("enabled", True)]


def _no_alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA).withColumn("detector_ordinal", F.lit(0))


def all_sections(params: Mapping[str, Any] | None) -> dict[str, Any]:
    """Merged settings; sections of detectors registered by the user pass through."""
    extra = {k: v for k, v in (params or {}).items() if k in _REGISTRY}
    return {**extra, **settings(params)}


def _build(name: str, packets: DataFrame, sections: Mapping[str, Any], by: list[str] | None = None) -> DataFrame:
    section = {**sections.get(name, {}), "by": by} if by else sections.get(name, {})
    alerts = _REGISTRY[name](packets, section)
    return alerts.select(*ALERT_SCHEMA.names, *(by or [])).withColumn("detector_ordinal", F.lit(detector_names().index(name)))


def detect_all(
    packets: DataFrame,
    params: Mapping[str, Any] | None = None,
    enabled: Iterable[str] | str | None = None,
    whitelist: Iterable[str] = (),
    sensor: str | None = None,
) -> DataFrame:
    """Alerts of all selected detectors, with ``detector_ordinal``.

    ``sensor`` names a column of the packets each value of which is watched by itself, as by an engine of its own; the alerts have it, too. It
    takes built-in detectors only, and fails on a packet without a sensor.
    Whitelisted packets enter no detector. If only the built-in detectors run, the columns they use are written to the scratch
    folder first, so the packets themselves are read once. The detectors' intermediate jobs are independent and run side by side.
    """
    sections = all_sections(params)
    names = select_detectors(params, enabled)
    watched = exclude_whitelisted(packets, list(whitelist) or sections["whitelist"])
    by = [sensor] if sensor else None
    if not names:
        return _no_alerts(packets.sparkSession)
    if all(is_built_in(name) for name in names):
        if sensor:
            known = F.when(F.col(sensor).isNull(), F.raise_error(F.lit("packet without a sensor")).cast("boolean")).otherwise(True)
            watched = watched.filter(known)
        watched = materialize(timed(watched).select(*WATCHED_COLUMNS, *(by or [])))
    elif by:
        raise ValueError("only built-in detectors know sensors")
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        build = inheritable_thread_target(packets.sparkSession)(_build)
        parts = list(pool.map(lambda name: build(name, watched, sections, by), names))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class DetectorStatus:
    detector: str
    ok: bool
    alerts: int
    error: str | None


def detect_isolated(
    packets: DataFrame,
    params: Mapping[str, Any] | None = None,
    enabled: Iterable[str] | str | None = None,
    whitelist: Iterable[str] = (),
) -> tuple[DataFrame, list[DetectorStatus]]:
    """Like ``detect_all``, but a detector that fails is logged and the others continue.

    Each detector runs as its own job and its alerts are written to the scratch
    folder, so a failure is seen here and not when the alerts are read.
    """
    sections = all_sections(params)
    spark = packets.sparkSession
    watched = exclude_whitelisted(packets, list(whitelist) or sections["whitelist"])
    parts, statuses = [_no_alerts(spark)], []
    for name in select_detectors(params, enabled):
        try:
            alerts = materialize(_build(name, watched, sections))
            statuses.append(DetectorStatus(name, True, alerts.count(), None))
            parts.append(alerts)
        except Exception as error:  # any failure of one detector must leave the others running
            logger.exception("detector %s failed", name)
            statuses.append(DetectorStatus(name, False, 0, f"{type(error).__name__}: {error}"))
    return reduce(DataFrame.unionByName, parts), statuses


def assign_ids(alerts: DataFrame, start: int = 1) -> DataFrame:
    """Adds the dense ``id`` in the order (packet arrival, detector), from ``start`` on.

    Numbering reads the alerts twice, so they are written out first and the packets are not read again.
    """
    return number_written(materialize(alerts), start)


def number_written(alerts: DataFrame, start: int = 1) -> DataFrame:
    """``assign_ids`` for alerts that are a written table.

    Numbered in chunks of arrival numbers: a chunk holds at most one alert per packet and detector, whatever the total.
    """
    chunk = slice_start(F.col("seq"), _ID_CHUNK)
    return dense_index(alerts, ["seq", "detector_ordinal"], chunk, "id", start)


def session_summary(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: ``packets`` processed (whitelisted ones included) and ``alerts`` raised."""
    each = packets.select(F.lit(1).alias("p"), F.lit(0).alias("a")).unionAll(alerts.select(F.lit(0), F.lit(1)))
    return each.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("packets"), F.coalesce(F.sum("a"), F.lit(0)).alias("alerts"))
