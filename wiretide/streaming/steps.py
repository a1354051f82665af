"""Port scans and SYN floods of a stream, micro-batch by micro-batch, with the batch operators.

A step gets a micro-batch's rows and what its window still needs of earlier ones. It counts with the operators of tables, which cut a
source's time into slices, so a source with most of a micro-batch is spread over many tasks. Between micro-batches a step keeps the live
rows (of ports, the latest) and the end of each source's cooldown.

Rows count in the order of time where they are known to come so (the stream holds them back). Otherwise they count as they
arrive. A source whose packets arrive in the order of time is counted as above; one whose packets don't is folded packet by packet, as
an expired packet behind a younger one still counts then.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import cooldown_us, slice_start, window_us
from ..operators.chain import cooldown
from ..operators.detectors import port_scan_alerts, ports_by_slice, syn_flood_alerts, with_live_ports
from ..operators.predicates import port_scan_eligible, syn_packets
from ..operators.sliding import sliding_count, sliding_distinct_count
from ..scratch import materialize
from .memory import StreamMemory
from .processors import FIRED_SCHEMA, Kept, PerSourceProcessor, PortScanProcessor, SynFloodProcessor

_LIVE = "src_ip string, ts_us bigint, seq bigint, dst_port int"
_OPENS = "src_ip string, opens bigint"
_NEVER = -(2**62)
# Arrival numbers looked at in one task when the order of arrival is compared with that of time.
_CHUNK = 1 << 16
# Rows of a source that are not worth a slice of their own.
_FEW = 1000

_FOLDED = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("dst_port", T.IntegerType()), T.StructField("opens", T.LongType()), *FIRED_SCHEMA.fields]
)


def port_scan_step(rows: DataFrame, p: Mapping[str, Any], memory: StreamMemory) -> DataFrame:
    new = port_scan_eligible(rows).select("src_ip", "ts_us", "seq", "dst_port")
    window, gap = window_us(p["time_window"]), cooldown_us(p["cooldown"])
    fired = _step(new, memory, PortScanProcessor(p["port_threshold"], window, gap))
    return port_scan_alerts(fired, p["port_threshold"], p["time_window"])


def syn_flood_step(rows: DataFrame, p: Mapping[str, Any], memory: StreamMemory) -> DataFrame:
    new = syn_packets(rows).select("src_ip", "ts_us", "seq", F.lit(None).cast("int").alias("dst_port"))
    window, gap = window_us(p["time_window"]), cooldown_us(p["cooldown"])
    fired = _step(new, memory, SynFloodProcessor(p["syn_threshold"], window, gap))
    return syn_flood_alerts(fired, p["syn_threshold"], p["time_window"])


def _step(new: DataFrame, memory: StreamMemory, rule: PerSourceProcessor) -> DataFrame:
    """What fires in a micro-batch: ``src_ip, ts_us, seq, observed, items``. Saves what the next one needs."""
    live = memory.read("live", _LIVE).withColumn("_old", F.lit(True))
    opens = memory.read("opens", _OPENS)
    rows = materialize(live.unionByName(new.withColumn("_old", F.lit(False))))
    fired, folded = None, None
    if not memory.ordered:
        odd = materialize(_out_of_order(rows))
        if not odd.isEmpty():
            folded = materialize(_fold(rows.join(odd, "src_ip", "left_semi"), opens, rule))
            rows = rows.join(odd, "src_ip", "left_anti")
    counted = _count(rows, rule)
    over = counted.filter(~F.col("_old") & (F.col("observed") >= rule.threshold)).join(opens, "src_ip", "left")
    over = over.filter(F.col("ts_us") >= F.coalesce("opens", F.lit(_NEVER))).select("src_ip", "ts_us", "seq", "observed")
    fired = materialize(cooldown(over, "src_ip", rule.gap))
    closed = fired.groupBy("src_ip").agg((F.max("ts_us") + F.lit(rule.gap)).alias("opens"))
    still = _still_live(rows, rule)
    if rule.value:
        fired = with_live_ports(fired, ports_by_slice(rows, rule.window, ["src_ip"]), rule.window, ["src_ip"])
    else:
        fired = fired.withColumn("items", F.lit(None).cast("array<string>"))
    if folded is not None:
        fired = fired.unionByName(folded.filter("kind = 'fired'").select(*fired.columns))
        closed = closed.unionByName(folded.filter("kind = 'opens'").select("src_ip", "opens"))
        still = still.unionByName(folded.filter("kind = 'live'").select(*still.columns))
    memory.write("live", still)
    memory.write("opens", opens.unionByName(closed).groupBy("src_ip").agg(F.max("opens").alias("opens")))
    return fired


def _count(rows: DataFrame, rule: PerSourceProcessor) -> DataFrame:
    """``observed`` of all rows; a source with more than its share of them gets slices of its own."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(_FEW, rows.count() // (2 * partitions))
    if rule.value:
        return sliding_distinct_count(rows, "src_ip", rule.value, rule.window / 1e6, most=most)
    return sliding_count(rows, "src_ip", rule.window / 1e6, most=most)


def _still_live(rows: DataFrame, rule: PerSourceProcessor) -> DataFrame:
    """The rows in the window of their source's latest one; of ports, the latest of each."""
    newest = rows.groupBy("src_ip").agg(F.max("ts_us").alias("_newest"))
    inside = rows.join(newest, "src_ip").filter(F.col("ts_us") >= F.col("_newest") - F.lit(rule.window))
    if not rule.value:
        return inside.select("src_ip", "ts_us", "seq", "dst_port")
    latest = inside.groupBy("src_ip", "dst_port").agg(F.max(F.struct("ts_us", "seq")).alias("_last"))
    return latest.select("src_ip", "_last.ts_us", "_last.seq", "dst_port")


def _out_of_order(rows: DataFrame) -> DataFrame:
    """The sources with a row that arrived after one of a later time. Compared chunk by chunk of arrival numbers, then over the chunks."""
    chunk = slice_start(F.col("seq"), _CHUNK).alias("_chunk")
    inside = Window.partitionBy("src_ip", "_chunk").orderBy("seq")
    steps = rows.select("src_ip", "ts_us", "seq", chunk).withColumn("_back", F.col("ts_us") < F.lag("ts_us").over(inside))
    chunks = steps.groupBy("src_ip", "_chunk").agg(
        F.min("ts_us").alias("_min"), F.max("ts_us").alias("_max"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("_back")
    )
    before = F.max("_max").over(Window.partitionBy("src_ip").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("_before", before).filter("_back OR _min < _before").select("src_ip").distinct()


def _fold(rows: DataFrame, opens: DataFrame, rule: PerSourceProcessor) -> DataFrame:
    """Sources one by one, in the order of arrival: rows of kind fired, live and opens."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable")
        old, new = group[group["_old"]], group[~group["_old"]].reset_index(drop=True)
        open_from = int(group["_opens"].iloc[0])
        times = old["ts_us"].tolist()
        rule.state = Kept((old["dst_port"].tolist(), times, open_from) if rule.value else (times, open_from))
        parts: Iterator[pd.DataFrame] = rule.fold(key[0], new) if len(new) else iter(())
        found = [part.assign(kind="fired") for part in parts]
        *_, times, open_from = rule.state.get()
        ports = rule.state.get()[0] if rule.value else [None] * len(times)
        # Before all that arrive later, in their order.
        numbers = range(-len(times), 0)
        found.append(pd.DataFrame({"kind": "live", "ts_us": times, "seq": numbers, "dst_port": ports}))
        found.append(pd.DataFrame({"kind": ["opens"], "opens": [open_from]}))
        out = pd.concat(found).reindex(columns=_FOLDED.names)
        out["src_ip"] = key[0]
        for name in ("ts_us", "seq", "observed", "opens", "dst_port"):
            out[name] = out[name].astype("Int64")
        return out.astype({"items": object}).where(out.notna(), None)

    open_from = F.coalesce("opens", F.lit(_NEVER)).alias("_opens")
    return rows.join(opens, "src_ip", "left").select(*rows.columns, open_from).groupBy("src_ip").applyInPandas(run, _FOLDED)
