"""Membership of textual IP addresses in lists of networks, as native expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings. Octets are decimal without leading zeros; groups have 1 to 4 hex digits.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
_GROUPS = r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z"
_SCOPED = r"\A[^%]*(?:%[^%]+)?\z"


def ipv4_number(ip: Column) -> Column:
    """Strict dotted quad as BIGINT; NULL for any other text."""
    part = F.split(ip, "\\.")
    octets = [F.try_element_at(part, F.lit(i + 1)).cast("bigint") for i in range(4)]
    value = reduce(lambda acc, octet: acc * 256 + octet, octets)
    return F.when(ip.rlike(_IPV4), value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 text as 32 lower-case hex digits; NULL for any other text.

    Accepts ``::``, an embedded dotted quad at the end and a ``%scope`` suffix.
    """
    bare = F.lower(F.substring_index(ip, "%", 1))
    parsed = _let(_without_quad(bare), lambda text: _let(F.split(text, "::", -1), _expanded))
    return F.when(F.contains(ip, F.lit(":")) & ip.rlike(_SCOPED), parsed)


def _without_quad(text: Column) -> Column:
    """Rewrites an embedded dotted quad as two hex groups."""
    tail = F.substring_index(text, ":", -1)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail))

    def rewritten(quad: Column) -> Column:
        low = F.pmod(quad, F.lit(65536).cast("bigint"))
        return F.concat(head, F.lower(F.hex(F.shiftright(quad, 16))), F.lit(":"), F.lower(F.hex(low)))

    return F.when(F.contains(tail, F.lit(".")), _let(ipv4_number(tail), rewritten)).otherwise(text)


def _expanded(sides: Column) -> Column:
    """The digits of the parts left and right of ``::``, with zeros between them."""
    left = F.try_element_at(sides, F.lit(1))
    right = F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit(""))

    def digits(side: Column) -> Column:
        groups = F.filter(F.split(side, ":", -1), lambda g: g != "")
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def joined(parts: Column) -> Column:
        given = F.length(parts[0]) + F.length(parts[1])
        fits = ((F.size(sides) == 1) & (given == 32)) | ((F.size(sides) == 2) & (given <= 28))
        return F.when(fits, F.concat(F.rpad(parts[0], F.lit(32) - F.length(parts[1]), F.lit("0")), parts[1]))

    well_formed = left.rlike(_GROUPS) & right.rlike(_GROUPS)
    return F.when(well_formed, _let(F.array(digits(left), digits(right)), joined))


def in_networks(ip: Column, entries: Iterable[str]) -> Column:
    """True if the address equals an entry or lies in its range; False for NULL or unparsable text.

    Entries are addresses or CIDR ranges; host bits are masked. An invalid entry
    raises ``ValueError``. The two versions never match each other. A single
    IPv4 address has one spelling only and is compared as text; ranges cost one
    set lookup per prefix length in the list (in steps of four bits for IPv6), however
    long the list is.
    """
    networks = [ipaddress.ip_network(entry, strict=False) for entry in entries]
    v4 = list(ipaddress.collapse_addresses(n for n in networks if n.version == 4))
    v6 = list(ipaddress.collapse_addresses(n for n in networks if n.version == 6))
    tests = []
    single = [str(n.network_address) for n in v4 if n.prefixlen == 32]
    if single:
        tests.append(ip.isin(single))
    masks = sorted({int(n.netmask) for n in v4 if n.prefixlen < 32}, reverse=True)
    if masks:
        members = {m: [int(n.network_address) for n in v4 if int(n.netmask) == m] for m in masks}
        tests.append(
            F.exists(
                F.array(ipv4_number(ip)),
                lambda n: _any([n.bitwiseAND(F.lit(m).cast("bigint")).isin(members[m]) for m in masks]),
            )
        )
    if v6:
        prefixes = hex_prefixes(v6)
        tests.append(
            F.exists(
                F.array(ipv6_hex(ip)),
                lambda h: _any([F.substring(h, 1, n).isin(members) for n, members in prefixes.items()]),
            )
        )
    return _any([F.coalesce(t, F.lit(False)) for t in tests]) if tests else F.lit(False)


def hex_prefixes(networks: Iterable[ipaddress.IPv6Network]) -> dict[int, list[str]]:
    """The ranges as prefixes of the address in 32 hexadecimal digits, by their length."""
    found: dict[int, list[str]] = {}
    for network in networks:
        digits = -(-network.prefixlen // 4)
        for part in network.subnets(new_prefix=4 * digits):
            found.setdefault(digits, []).append(f"{int(part.network_address):032x}"[:digits])
    return found


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
