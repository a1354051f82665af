"""Row filters that decide which packets a detector looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import syn_letters


def port_scan_eligible(packets: DataFrame) -> DataFrame:
    """TCP or UDP packets with a source and a destination port (port 0 counts)."""
    return packets.filter(
        (F.col("src_ip") != "") & F.col("dst_port").isNotNull() & F.col("protocol").isin("TCP", "UDP")
    )


def arp_eligible(packets: DataFrame) -> DataFrame:
    """ARP bindings; the unspecified address of address probes is left out."""
    return packets.filter(
        F.col("is_arp") & (F.col("src_ip") != "") & (F.col("src_ip") != "0.0.0.0") & (F.col("src_mac") != "")
    )


def syn_packets(packets: DataFrame) -> DataFrame:
    """TCP connection attempts with a source."""
    return packets.filter((F.col("protocol") == "TCP") & (F.col("src_ip") != "") & syn_letters(F.col("tcp_flags")))


def filter_alerts(alerts: DataFrame, event_type: str | None = None, source_ip: str | None = None) -> DataFrame:
    """Optional equality filters; ``None`` and ``''`` mean no filter."""
    if event_type:
        alerts = alerts.filter(F.col("event_type") == event_type)
    if source_ip:
        alerts = alerts.filter(F.col("source_ip") == source_ip)
    return alerts
