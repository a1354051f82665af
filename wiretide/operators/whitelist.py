"""Exclusion of trusted sources."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import hex_prefixes, in_networks, ipv4_number, ipv6_hex

# Longer lists are joined and not written into the plan.
LISTED_IN_PLAN = 2000


def exclude_whitelisted(packets: DataFrame, entries: Iterable[str], col: str = "src_ip") -> DataFrame:
    """Drops packets whose address is in the list. NULL and unparsable addresses stay."""
    entries = list(entries)
    if not entries:
        return packets
    if len(entries) <= LISTED_IN_PLAN:
        return packets.filter(~in_networks(F.col(col), entries))
    listed, places = _lookup(packets, entries)
    return _unlisted_stream(packets, listed, places, col) if packets.isStreaming else packets.join(_listed(packets, listed, places, col), col, "left_anti")


def _lookup(packets: DataFrame, entries: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The list as a table (_kind, _key) of prefixes by length, and for each length what an address (_v4, _v6) has there."""
    networks = [ipaddress.ip_network(entry, strict=False) for entry in entries]
    v4 = list(ipaddress.collapse_addresses(n for n in networks if n.version == 4))
    v6 = hex_prefixes(ipaddress.collapse_addresses(n for n in networks if n.version == 6))
    rows = [(f"4/{n.prefixlen}", str(int(n.network_address))) for n in v4]
    rows += [(f"6/{digits}", prefix) for digits, prefixes in v6.items() for prefix in prefixes]
    places = {f"4/{n.prefixlen}": F.col("_v4").bitwiseAND(F.lit(int(n.netmask)).cast("bigint")).cast("string") for n in v4}
    places |= {f"6/{n}": F.substring("_v6", 1, n) for n in v6}
    return packets.sparkSession.createDataFrame(rows, "_kind string, _key string"), places


def _listed(packets: DataFrame, listed: DataFrame, places: dict[str, Column], col: str) -> DataFrame:
    """The addresses of the packets that are in the list: each distinct one is looked up once per prefix length."""
    addresses = packets.select(col).distinct().select(col, ipv4_number(F.col(col)).alias("_v4"), ipv6_hex(F.col(col)).alias("_v6"))
    looked_up = addresses.select(col, F.inline(F.array(*[F.struct(F.lit(k).alias("_kind"), c.alias("_key")) for k, c in places.items()])))
    return looked_up.join(listed, ["_kind", "_key"], "left_semi").select(col).distinct()


def _unlisted_stream(packets: DataFrame, listed: DataFrame, places: dict[str, Column], col: str) -> DataFrame:
    """The same for a stream: one join with the static list per prefix length, and what is found in none stays."""
    rows = packets.withColumns({"_v4": ipv4_number(F.col(col)), "_v6": ipv6_hex(F.col(col))})
    for kind, key in places.items():
        prefixes = listed.filter(F.col("_kind") == kind).select(F.col("_key").alias("_prefix")).distinct().withColumn("_hit", F.lit(1))
        joined = rows.withColumn("_place", key).join(prefixes, F.col("_place") == F.col("_prefix"), "left")
        rows = joined.filter(F.col("_hit").isNull()).drop("_place", "_prefix", "_hit")
    return rows.select(*packets.columns)
