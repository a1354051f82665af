"""Raw frames to packet records, with native byte expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packets import as_packets

# Fixed values from the protocol standards.
ETHERTYPE_IPV4 = "0800"
ETHERTYPE_ARP = "0806"
ETHERTYPE_IPV6 = "86DD"
VLAN_TAGS = ("8100", "88A8")
PROTO_TCP, PROTO_UDP = 6, 17
# One letter per TCP flag bit, lowest bit first.
TCP_FLAG_LETTERS = "FSRPAUECN"

LINKTYPES = ("ethernet", "raw")


def _hex_at(offset: Column | int, n_bytes: int) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.hex(F.substr(F.col("frame"), offset + 1, F.lit(n_bytes)))


def _number_at(offset: Column | int, n_bytes: int) -> Column:
    return F.conv(_hex_at(offset, n_bytes), 16, 10).cast("bigint")


def _high_nibble(offset: Column | int) -> Column:
    return F.substr(_hex_at(offset, 1), F.lit(1), F.lit(1))


def _mac_at(offset: Column | int) -> Column:
    return F.lower(F.concat_ws(":", *[_hex_at(offset + i, 1) for i in range(6)]))


def _dotted(number: Column) -> Column:
    octets = [F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def _flag_letters(bits: Column) -> Column:
    """A lookup in the letters of all 512 flag combinations."""
    letters = ["".join(c for i, c in enumerate(TCP_FLAG_LETTERS) if bits >> i & 1) for bits in range(512)]
    # Guarded, since element_at with a NULL index is taken to be non-null when the array is.
    table = F.split(F.lit(",".join(letters)), ",")  # a constant
    return F.when(bits.isNotNull(), F.element_at(table, bits.cast("int") + 1))


def _link_layer(frames: DataFrame, linktype: str) -> DataFrame:
    """Adds the ``_size``, the ethertype ``_type`` and the offset ``_l3`` of the network header."""
    if linktype not in LINKTYPES:
        raise ValueError(f"unknown linktype {linktype!r}; expected one of {list(LINKTYPES)}")
    raw = frames.filter(F.col("frame").isNotNull()).select("*", F.length("frame").alias("_size"))
    if linktype == "raw":
        version = _high_nibble(0)
        kind = F.when(version == "4", F.lit(ETHERTYPE_IPV4)).when(version == "6", F.lit(ETHERTYPE_IPV6))
        return raw.select("*", F.lit(0).alias("_l3"), kind.alias("_type"))
    outer, inner = _hex_at(12, 2).isin(*VLAN_TAGS), _hex_at(16, 2).isin(*VLAN_TAGS)
    l3 = F.when(outer & inner, 22).when(outer, 18).otherwise(14)
    return raw.withColumn("_l3", l3).withColumn("_type", _hex_at(F.col("_l3") - 2, 2))


def capture_filter(frames: DataFrame, predicate: Column | None = None, linktype: str = "ethernet") -> DataFrame:
    """Keeps IPv4 and ARP frames, or the frames that satisfy ``predicate``."""
    if predicate is not None:
        return frames.filter(predicate)
    if linktype == "raw":
        return frames.filter(_high_nibble(0) == "4")
    return frames.filter(_hex_at(12, 2).isin(ETHERTYPE_IPV4, ETHERTYPE_ARP))


def decode_frames(frames: DataFrame, frame_col: str = "frame", linktype: str = "ethernet") -> DataFrame:
    """Packet columns of each frame, plus the frame itself and ``decode_error``.

    NULL frames are dropped. VLAN tags are skipped. ARP takes its addresses from
    the payload. Frames that are neither IPv4 nor ARP keep their row and MACs.
    Ports need a first fragment and a complete transport header.
    """
    frames = frames.withColumnRenamed(frame_col, "frame") if frame_col != "frame" else frames
    # One step per header, each adding columns the next ones read: every byte is parsed once.
    linked = _link_layer(frames, linktype)
    l3, size = F.col("_l3"), F.col("_size")
    is_arp, is_ipv4 = F.col("_type") == ETHERTYPE_ARP, F.col("_type") == ETHERTYPE_IPV4
    network = linked.select(
        "*",
        # IPv4: version, header length, service, total length; fragment offset, time to live, protocol.
        F.when(is_ipv4, _number_at(l3, 4)).alias("_head"),
        # ARP: address lengths and operation.
        F.when(is_ipv4, _number_at(l3 + 6, 4)).when(is_arp, _number_at(l3 + 4, 4)).alias("_mid"),
        F.when(is_ipv4 | is_arp, _number_at(l3 + F.when(is_arp, 14).otherwise(12), 4)).alias("_src"),
        F.when(is_ipv4 | is_arp, _number_at(l3 + F.when(is_arp, 24).otherwise(16), 4)).alias("_dst"),
    )
    head, mid = F.col("_head"), F.col("_mid")
    header_length = F.shiftright(head, 24).bitwiseAND(F.lit(15)) * 4
    error = (
        F.when(size < F.greatest(l3, F.lit(1)), "short link header")
        .when(is_arp & ((size < l3 + 28) | (F.shiftright(mid, 16) != 0x0604)), "bad ARP body")
        .when(is_ipv4 & ((size < l3 + 20) | (F.shiftright(head, 28) != 4) | (header_length < 20)), "bad IPv4 header")
    )
    total = head.bitwiseAND(F.lit(0xFFFF))
    first_fragment = mid.bitwiseAND(F.lit(0x1FFF0000)) == 0
    outcome = F.struct(
        error.alias("decode_error"),
        (l3 + header_length).cast("int").alias("_l4"),
        # The payload ends at the length the IPv4 header gives; the rest is link padding.
        F.when(total >= header_length, F.least(size, l3 + total)).otherwise(size).alias("_end"),
        F.when(is_ipv4 & first_fragment, mid.bitwiseAND(F.lit(0xFF))).alias("_proto"),
    )
    # As a generated row, so that a filter on the outcome is not pushed below the parsing and does it all again.
    checked = network.select("*", F.inline(F.array(outcome)))
    sound, l4, room = F.col("decode_error").isNull(), F.col("_l4"), F.col("_end") - F.col("_l4")
    protocol = (
        F.when(~sound, None)
        .when(is_arp, "ARP")
        .when((F.col("_proto") == PROTO_TCP) & (room >= 20), "TCP")
        .when((F.col("_proto") == PROTO_UDP) & (room >= 8), "UDP")
        .when(is_ipv4, "IP")
    )
    named = checked.select("*", protocol.alias("protocol"))
    kind = F.col("protocol")
    carried = named.select(
        "*",
        F.when(kind.isin("TCP", "UDP"), _number_at(l4, 4)).alias("_ports"),
        F.when(kind == "TCP", _number_at(l4 + 12, 2).bitwiseAND(F.lit(0x1FF))).alias("_flags"),
        F.coalesce(kind == "ARP", F.lit(False)).alias("is_arp"),
    )
    from_arp, ports = F.col("is_arp"), F.col("_ports")
    if linktype == "ethernet":
        has_macs = size >= 14
        src_mac = F.when(has_macs, _mac_at(F.when(from_arp, l3 + 8).otherwise(6)))
        dst_mac = F.when(has_macs, _mac_at(F.when(from_arp, l3 + 18).otherwise(0)))
    else:
        src_mac = dst_mac = F.lit(None).cast("string")
    return carried.select(
        "seq",
        "ts",
        F.when(kind.isNotNull(), _dotted(F.col("_src"))).alias("src_ip"),
        F.when(kind.isNotNull(), _dotted(F.col("_dst"))).alias("dst_ip"),
        src_mac.alias("src_mac"),
        dst_mac.alias("dst_mac"),
        "protocol",
        F.shiftright(ports, 16).cast("int").alias("src_port"),
        ports.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("dst_port"),
        _flag_letters(F.col("_flags")).alias("tcp_flags"),
        "is_arp",
        F.when(from_arp, mid.bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("arp_op"),
        size.alias("length"),
        "frame",
        "decode_error",
    )


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(packets, quarantine)``: frames that could not be parsed are set aside with their error."""
    good = as_packets(decoded.filter(F.col("decode_error").isNull()).drop("frame", "decode_error"))
    quarantine = decoded.filter(F.col("decode_error").isNotNull()).select("seq", "ts", "frame", "decode_error")
    return good, quarantine
