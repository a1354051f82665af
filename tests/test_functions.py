from __future__ import annotations

import ipaddress
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wiretide.functions.addresses import in_networks, ipv4_number, ipv6_hex
from wiretide.functions.flags import is_syn
from wiretide.functions.text import number_list, one_decimal, quoted_list
from wiretide.functions.timing import iso_utc
from wiretide.operators import whitelist
from wiretide.operators.whitelist import exclude_whitelisted

ADDRESSES = [
    None, "", "10.0.0.1", "10.0.0.01", "10.0.0.256", "1.2.3", "1.2.3.4.5", " 10.0.0.1", "10.0.0.1\n", "255.255.255.255",
    "0.0.0.0", "192.168.1.77", "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:1:2:3:4:5:6",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
    "1::2::3", ":::", "::ffff:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "64:ff9b::10.0.0.1", "fe80::1%eth0", "fe80::1%",
    "fe80::1%a%b", "12345::", "g::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "1::8:7:6:5:4:3:2", "x",
    "::0:0:0:0:0:0:0:1", "2001:db8::0.0.0.5", "1:2:3:4:5:6:7::8",
]


def parsed(text):
    try:
        return ipaddress.ip_address(text) if text is not None else None
    except ValueError:
        return None


def test_parsing_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    for row in df.select("a", ipv4_number(F.col("a")).alias("v4"), ipv6_hex(F.col("a")).alias("v6")).collect():
        address = parsed(row.a)
        assert row.v4 == (int(address) if address is not None and address.version == 4 else None), row.a
        assert row.v6 == (f"{int(address):032x}" if address is not None and address.version == 6 else None), row.a


@pytest.mark.parametrize(
    "entries",
    [
        ["10.0.0.1"],
        ["10.0.0.5/24", "192.168.0.0/16"],
        ["0.0.0.0/0"],
        ["::/0"],
        ["2001:db8::/32", "::1", "10.0.0.0/8"],
        ["::ffff:0:0/96", "fe80::/10"],
        ["2001:db8::/33", "2001:db8:8000::/35", "64:ff9b::a00:0/106", "::/1"],
    ],
)
def test_networks(spark, entries):
    rng = random.Random(7)
    extra = [f"10.0.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(50)]
    df = spark.createDataFrame([(a,) for a in [*ADDRESSES, *extra]], "a string")
    networks = [ipaddress.ip_network(e, strict=False) for e in entries]
    for row in df.select("a", in_networks(F.col("a"), entries).alias("hit")).collect():
        address = parsed(row.a)
        assert row.hit == (address is not None and any(address in n for n in networks)), row.a


@pytest.mark.parametrize("extra", [["10.0.0.0/8", "2001:db8::/35"], ["::/0"], ["0.0.0.0/0", "192.168.1.77"]])
def test_long_lists_are_joined(spark, monkeypatch, extra):
    """The same rows stay as with the list in the plan."""
    rng = random.Random(9)
    entries = [f"{rng.randrange(256)}.{rng.randrange(256)}.0.0/{rng.randrange(9, 33)}" for _ in range(300)] + extra
    sources = [a for a in ADDRESSES] + [f"{rng.randrange(256)}.{rng.randrange(256)}.0.{rng.randrange(4)}" for _ in range(600)]
    df = spark.createDataFrame([(a, i) for i, a in enumerate(sources + sources[:50])], "src_ip string, seq int")
    short = sorted(r.seq for r in exclude_whitelisted(df, entries).collect())
    monkeypatch.setattr(whitelist, "LISTED_IN_PLAN", 10)
    joined = exclude_whitelisted(df, entries)
    assert sorted(r.seq for r in joined.collect()) == short and set(joined.columns) == set(df.columns)
    assert 0 < len(short) < df.count()


def test_bad_entry_raises(spark):
    with pytest.raises(ValueError):
        in_networks(F.col("a"), ["10.0.0.0/33"])
    with pytest.raises(ValueError):
        in_networks(F.col("a"), ["nonsense"])


def test_one_decimal_rounds_the_binary_value(spark):
    rng = random.Random(3)
    values = [i / d for d in (1, 2, 3, 4, 5, 6, 7, 8, 10, 20, 40, 100) for i in range(400)]
    values += [rng.random() * 10 ** rng.randrange(9) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", one_decimal(F.col("x")).alias("t")).collect():
        assert row.t == f"{row.x:.1f}", row.x


def test_list_text(spark):
    lists = [["a"], ["aa:bb", "c"], ["it's"], ['"'], ["'\""], ["back\\slash"], []]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    for row in df.select("x", quoted_list(F.col("x")).alias("t")).collect():
        assert row.t == str(row.x)
    assert spark.range(1).select(number_list(F.array(F.lit("1"), F.lit("2")))).first()[0] == "[1, 2]"


def test_iso_text(spark):
    micros = [0, 1, 999_999, 1_000_000, 1_700_000_000_000_000, 1_700_000_000_123_456, 86_399_999_999, 86_400_000_000]
    df = spark.createDataFrame([(m,) for m in micros], "m bigint")
    for row in df.select("m", iso_utc(F.col("m")).alias("t")).collect():
        whole = datetime.fromtimestamp(row.m // 1_000_000, tz=timezone.utc).replace(microsecond=row.m % 1_000_000)
        assert row.t == whole.isoformat()


def test_is_syn(spark):
    expected = {"S": True, "SF": True, "SEC": True, "SA": False, "A": False, "": False, None: False, "s": False}
    df = spark.createDataFrame([(f,) for f in expected], "f string")
    assert {r.f: r.s for r in df.select("f", is_syn(F.col("f")).alias("s")).collect()} == expected
