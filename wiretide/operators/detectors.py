"""The four detectors: packets in, alerts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_list, one_decimal, quoted_list
from ..functions.timing import cooldown_us, slice_start, window_us
from ..schema import ALERT_COLUMNS, ARP_SPOOF, PORT_SCAN, SYN_FLOOD, TRAFFIC_ANOMALY
from ..scratch import materialize
from ..sources.packets import timed
from .chain import cooldown
from .distinct import cumulative_distinct, first_arrivals
from .predicates import arp_eligible, port_scan_eligible, syn_packets
from .slices import crowded_keys
from .sliding import sliding_count, sliding_distinct_count
from .windows import anchored_windows, assign_windows, rolling_baseline, top_source_per_window, window_starts

# Fixed value: how many ports the text of a port-scan alert lists. The column ``items`` has them all.
LISTED_PORTS = 20


def _alerts(
    fired: DataFrame,
    event_type: str,
    details: Column,
    threshold: float | Column,
    rate: Column | None = None,
    items: Column | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    columns = {
        "seq": F.col("seq").cast("bigint"),
        "ts_us": F.col("ts_us"),
        "timestamp": F.timestamp_micros("ts_us"),
        "source_ip": F.col("src_ip"),
        "event_type": F.lit(event_type),
        "details": details,
        "observed": F.col("observed").cast("bigint"),
        "threshold": threshold if isinstance(threshold, Column) else F.lit(float(threshold)),
        "rate": rate if rate is not None else F.lit(None).cast("double"),
        "items": items if items is not None else F.lit(None).cast("array<string>"),
    }
    return fired.select(*[columns[name].alias(name) for name in ALERT_COLUMNS], *(by or []))


def _arrived_by(ts: Column, seq: Column, at_ts: Column, at_seq: Column) -> Column:
    return (ts < at_ts) | ((ts == at_ts) & (seq <= at_seq))


def detect_port_scan(
    packets: DataFrame,
    port_threshold: int = 15,
    window_s: float = 10.0,
    cooldown_s: float = 30.0,
    slice_s: float | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Sources that reach ``port_threshold`` distinct destination ports within the window.

    ``by``, here and in the other detectors, names columns (such as the sensor) each value of which is watched by itself.
    """
    window, keys = window_us(window_s), [*(by or []), "src_ip"]
    eligible = port_scan_eligible(timed(packets)).select(*keys, "dst_port", "ts_us", "seq")

    seen = materialize(ports_by_slice(eligible, window, keys))
    per_slice = seen.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum("_rows").alias("_rows"))
    suspects, longest = crowded_keys(per_slice, keys, window, port_threshold)
    watched = eligible.join(suspects, keys, "left_semi")

    counted = sliding_distinct_count(watched, keys, "dst_port", window_s, slice_s, longest=longest)
    over = counted.filter(F.col("observed") >= port_threshold).select(*keys, "ts_us", "seq", "observed")
    fired = materialize(cooldown(over, keys, cooldown_us(cooldown_s), longest=longest))
    return port_scan_alerts(with_live_ports(fired, seen, window, keys), port_threshold, window_s, by)


def ports_by_slice(rows: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """The first and the last packet to each port in each slice of the window's length, and their number: a combining aggregate."""
    own = slice_start(F.col("ts_us"), window)
    first, last = F.min(F.struct("ts_us", "seq")).alias("_first"), F.max("ts_us").alias("_last")
    return rows.groupBy(*keys, own.alias("_slice"), "dst_port").agg(first, last, F.count(F.lit(1)).alias("_rows"))


def with_live_ports(fired: DataFrame, seen: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """``fired`` and the live ports of each row as ``items``; ``seen`` is ``ports_by_slice``.

    These are the ports met early enough in the row's own slice, and those met late enough in the slice before. A slice's ports are put
    in one array (of 65,536 at most) and cut for each alert.
    """
    fired = fired.withColumn("_slice", slice_start(F.col("ts_us"), window))
    target = F.explode(F.array(F.struct(F.col("_slice").alias("to"), F.lit(True).alias("own")), F.struct((F.col("_slice") + F.lit(window)).alias("to"), F.lit(False).alias("own"))))
    sent = seen.select(*keys, "dst_port", "_first", "_last", target.alias("_t"))
    sent = sent.select(*keys, F.col("_t.to").alias("_slice"), F.col("_t.own").alias("_own"), "dst_port", "_first", "_last")
    needed = sent.join(fired.select(*keys, "_slice"), [*keys, "_slice"], "left_semi")
    here = F.when(F.col("_own"), F.struct("_first", "dst_port"))
    there = F.when(~F.col("_own"), F.struct("_last", "dst_port"))
    ports = needed.groupBy(*keys, "_slice").agg(F.collect_list(here).alias("_here"), F.collect_list(there).alias("_there"))
    joined = fired.join(ports, [*keys, "_slice"])
    early = F.filter("_here", lambda p: _arrived_by(p["_first"]["ts_us"], p["_first"]["seq"], F.col("ts_us"), F.col("seq")))
    late = F.filter("_there", lambda p: p["_last"] >= F.col("ts_us") - F.lit(window))
    live = F.array_sort(F.array_union(early["dst_port"], late["dst_port"])).cast("array<string>")
    return joined.withColumn("items", live).drop("_slice", "_here", "_there")


def port_scan_alerts(fired: DataFrame, port_threshold: int, window_s: float, by: list[str] | None = None) -> DataFrame:
    """Alerts from ``src_ip, ts_us, seq, observed, items``."""
    details = F.concat(
        F.col("observed").cast("string"),
        F.lit(f" distinct ports contacted within {window_s:.0f}s (threshold: {port_threshold}); recent ports: "),
        number_list(F.slice("items", 1, LISTED_PORTS)),
    )
    return _alerts(fired, PORT_SCAN, details, port_threshold, items=F.col("items"), by=by)


def detect_arp_spoof(
    packets: DataFrame, cooldown_s: float = 60.0, slice_s: float | None = None, by: list[str] | None = None
) -> DataFrame:
    """Addresses bound to two or more MACs; a MAC not seen before alerts at once."""
    keys = [*(by or []), "src_ip"]
    eligible = arp_eligible(timed(packets)).select(*keys, "src_mac", "ts_us", "seq")
    firsts = materialize(first_arrivals(eligible, keys, "src_mac"))
    # Only addresses with two MACs at some time can alert.
    order = F.struct("ts_us", "seq", "src_mac")
    bound = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_bound"), F.sum("_rows").alias("_rows"))
    bound = materialize(bound.filter(F.size("_bound") >= 2))
    most = bound.select("_rows").sort(F.desc("_rows")).head()
    longest = most[0] if most else 0
    suspects = bound.select(*keys)
    counted = cumulative_distinct(
        eligible.join(suspects, keys, "left_semi"), keys, "src_mac", slice_s, firsts=firsts.join(suspects, keys, "left_semi"), longest=longest
    )
    over = counted.filter(F.col("observed") >= 2).drop("src_mac")
    fired = cooldown(over, keys, cooldown_us(cooldown_s), forced="first_seen", longest=longest)
    # The MACs so far are the first ``observed`` in the order in which they were bound.
    so_far = F.slice("_bound", F.lit(1), F.col("observed").cast("int"))["src_mac"]
    return arp_spoof_alerts(fired.join(bound.drop("_rows"), keys).withColumn("items", F.array_sort(so_far)), by)


def arp_spoof_alerts(fired: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Alerts from ``src_ip, ts_us, seq, observed, items``."""
    details = F.concat(
        F.lit("IP "),
        F.col("src_ip"),
        F.lit(" is associated with "),
        F.col("observed").cast("string"),
        F.lit(" MAC addresses: "),
        quoted_list(F.col("items")),
    )
    return _alerts(fired, ARP_SPOOF, details, 2, items=F.col("items"), by=by)


def detect_syn_flood(
    packets: DataFrame,
    syn_threshold: int = 100,
    window_s: float = 5.0,
    cooldown_s: float = 30.0,
    slice_s: float | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Sources that send ``syn_threshold`` connection attempts within the window."""
    window, keys = window_us(window_s), [*(by or []), "src_ip"]
    eligible = syn_packets(timed(packets)).select(*keys, "ts_us", "seq")
    rows = F.count(F.lit(1))
    per_slice = eligible.groupBy(*keys, slice_start(F.col("ts_us"), window).alias("_slice")).agg(rows.alias("_n"), rows.alias("_rows"))
    suspects, longest = crowded_keys(per_slice, keys, window, syn_threshold)
    counted = sliding_count(eligible.join(suspects, keys, "left_semi"), keys, window_s, slice_s, longest=longest)
    fired = cooldown(counted.filter(F.col("observed") >= syn_threshold), keys, cooldown_us(cooldown_s), longest=longest)
    return syn_flood_alerts(fired, syn_threshold, window_s, by)


def syn_flood_alerts(fired: DataFrame, syn_threshold: int, window_s: float, by: list[str] | None = None) -> DataFrame:
    """Alerts from ``src_ip, ts_us, seq, observed``."""
    rate = F.col("observed").cast("double") / F.lit(float(window_s))
    details = F.concat(
        F.col("observed").cast("string"),
        F.lit(f" SYN packets within {window_s:.0f}s (~"),
        one_decimal(rate),
        F.lit(f" SYN/s, threshold: {syn_threshold})"),
    )
    return _alerts(fired, SYN_FLOOD, details, syn_threshold, rate=rate, by=by)


def detect_traffic_anomaly(
    packets: DataFrame,
    window_s: float = 10.0,
    baseline_windows: int = 6,
    multiplier: float = 3.0,
    min_samples: int = 3,
    by: list[str] | None = None,
) -> DataFrame:
    """Closed windows with more than ``multiplier`` times the packets of the windows before them.

    The alert carries the time and ``seq`` of the packet that closed the window.
    """
    packets = timed(packets)
    starts = window_starts(packets, window_s, by=by)
    windows = rolling_baseline(anchored_windows(packets, window_s, starts, by=by), baseline_windows, by)
    return spike_alerts(packets, windows, window_s, multiplier, min_samples, by=by)


def spike_alerts(
    packets: DataFrame,
    windows: DataFrame,
    window_s: float,
    multiplier: float,
    min_samples: int,
    weight: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Alerts for the windows that exceed their baseline. A row counts as ``weight`` packets, or as one."""
    by = by or []
    spikes = materialize(spikes_of(windows, multiplier, min_samples))
    # Sources are ranked in the spikes only: the start table of the spikes places just their packets.
    placed = assign_windows(
        packets.select(*by, "ts_us", "seq", "src_ip", *([weight] if weight else [])), spikes.select(*by, "window_start", "close_us"), window_s, close="close_us", by=by
    )
    return spike_texts(spikes, top_source_per_window(placed, weight=weight, by=by), window_s, multiplier, by)


def spikes_of(windows: DataFrame, multiplier: float, min_samples: int) -> DataFrame:
    """The closed windows that exceed their baseline."""
    over = F.col("n") > F.lit(float(multiplier)) * F.col("baseline_avg")
    judged = (F.col("baseline_n") >= min_samples) & (F.col("baseline_avg") > 0)
    return windows.filter(F.col("close_us").isNotNull() & judged & over)


def spike_texts(spikes: DataFrame, top: DataFrame, window_s: float, multiplier: float, by: list[str] | None = None) -> DataFrame:
    """Alerts from ``spikes_of`` and ``top_source_per_window``."""
    by = by or []
    fired = spikes.join(top, [*by, "window_start"]).select(
        *by,
        F.col("close_seq").alias("seq"),
        F.col("close_us").alias("ts_us"),
        F.col("top_ip").alias("src_ip"),
        F.col("n").alias("observed"),
        "baseline_avg",
        "top_count",
    )
    details = F.concat(
        F.col("observed").cast("string"),
        F.lit(f" packets in {window_s:.0f}s window exceeds {multiplier}x baseline average ("),
        one_decimal(F.col("baseline_avg")),
        F.lit(" packets); top source: "),
        F.col("src_ip"),
        F.lit(" ("),
        F.col("top_count").cast("string"),
        F.lit(" packets)"),
    )
    threshold = F.lit(float(multiplier)) * F.col("baseline_avg")
    return _alerts(fired, TRAFFIC_ANOMALY, details, threshold, rate=F.col("baseline_avg"), by=by)
