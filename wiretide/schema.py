"""Packet and alert schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET_FIELDS = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("is_arp", T.BooleanType()),
        T.StructField("arp_op", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)

PACKET_COLUMNS = ["seq", "ts", "ts_us", "event_time"] + [f.name for f in PACKET_FIELDS if f.name != "ts"]

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("observed", T.LongType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)

ALERT_COLUMNS = ALERT_SCHEMA.names

# The four alert types, in detector order.
PORT_SCAN = "PORT_SCAN"
ARP_SPOOF = "ARP_SPOOF"
SYN_FLOOD = "SYN_FLOOD"
TRAFFIC_ANOMALY = "TRAFFIC_ANOMALY"
EVENT_TYPES = (PORT_SCAN, ARP_SPOOF, SYN_FLOOD, TRAFFIC_ANOMALY)
