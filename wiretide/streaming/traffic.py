"""Traffic anomalies of a stream, micro-batch by micro-batch, and rows held back until later ones can't come.

The window chain is global, so a keyed stateful operator would send the whole stream through one task. Instead each batch is joined by
what the window left open before it holds (per source, the number of packets and the first one) and by the sizes of the last closed windows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import slice_start
from ..operators.detectors import spike_texts, spikes_of
from ..operators.windows import assign_windows, top_source_per_window, window_starts
from ..scratch import materialize
from .memory import StreamMemory

_CARRIED = "src_ip string, ts_us bigint, seq bigint, weight bigint"
# Packets of one chunk of arrival numbers are brought into order in one task.
_ARRIVAL_CHUNK = 1 << 20


def hold_back(rows: DataFrame, lateness: int, memory: StreamMemory) -> DataFrame:
    """The rows that no row can come before any more: older than the newest by ``lateness`` or more, held ones included.

    Rows older than what was given out before are dropped and counted (``late`` of the table marks).
    """
    spark = rows.sparkSession
    taken_us, late = memory.read("marks", "taken_us bigint, late bigint").first() or (None, 0)
    newest, too_late = rows.agg(F.max("ts_us"), F.count(F.when(F.col("ts_us") < F.lit(taken_us).cast("bigint"), 1))).first()
    held = memory.read("held", rows.schema)
    if taken_us is not None:
        rows = rows.filter(F.col("ts_us") >= taken_us)
    if newest is not None:
        taken_us = max(newest - lateness, taken_us if taken_us is not None else newest - lateness)
    rows = materialize(held.unionByName(rows))
    up_to = F.lit(taken_us if taken_us is not None else 0)
    memory.write("held", rows.filter(F.col("ts_us") >= up_to))
    memory.write("marks", spark.createDataFrame([(taken_us, late + too_late)], "taken_us bigint, late bigint").coalesce(1))
    return rows.filter(F.col("ts_us") < up_to)


def traffic_step(rows: DataFrame, p: Mapping[str, Any], memory: StreamMemory) -> DataFrame:
    """The alerts of a micro-batch. Its packets are placed once; what follows works on the packets per window and source."""
    rows = rows.select("src_ip", "ts_us", "seq", F.lit(1).cast("bigint").alias("weight"))
    last = None if memory.ordered else memory.read("latest", "taken_us bigint").first()
    if not memory.ordered:
        rows = _by_arrival(rows, last.taken_us if last else None)
    rows = materialize(memory.read("open", _CARRIED).unionByName(rows))
    if not memory.ordered:
        newest = F.greatest(F.max("ts_us"), F.lit(last.taken_us if last else None).cast("bigint"))
        memory.write("latest", rows.agg(newest.alias("taken_us")))
    starts = window_starts(rows, p["window_seconds"], rows=rows.count())
    first = F.min(F.struct("ts_us", "seq")).alias("first")
    held = assign_windows(rows, starts, p["window_seconds"]).groupBy("window_start", "src_ip").agg(first, F.sum("weight").alias("weight"))
    held = materialize(held.select("window_start", "src_ip", "first.ts_us", "first.seq", "weight"))
    # One row per window of the micro-batch, and the last windows before it.
    in_order = Window.orderBy("window_start")
    windows = held.groupBy("window_start").agg(F.sum("weight").alias("n"), F.min(F.struct("ts_us", "seq"))["seq"].alias("first_seq"))
    windows = windows.select(
        (F.row_number().over(in_order) - 1).cast("bigint").alias("window_id"),
        "window_start",
        "n",
        F.lead("window_start").over(in_order).alias("close_us"),
        F.lead("first_seq").over(in_order).alias("close_seq"),
    )
    history = memory.read("closed", "window_id bigint, n bigint")
    before = Window.orderBy("window_id").rowsBetween(-p["baseline_windows"], -1)
    judged = windows.unionByName(history, allowMissingColumns=True)
    judged = materialize(judged.withColumns({"baseline_avg": F.avg("n").over(before), "baseline_n": F.count("n").over(before)}))
    spikes = spikes_of(judged, p["multiplier"], p["min_baseline_samples"])
    top = top_source_per_window(held.join(spikes.select("window_start"), "window_start", "left_semi"), weight="weight")
    alerts = materialize(spike_texts(spikes, top, p["window_seconds"], p["multiplier"]))
    open_window = judged.filter("window_start IS NOT NULL AND close_us IS NULL").select("window_start")
    memory.write("open", held.join(open_window, "window_start", "left_semi").select("src_ip", "ts_us", "seq", "weight"))
    closed = judged.filter("window_start IS NULL OR close_us IS NOT NULL").select("window_id", "n")
    newest_first = Window.orderBy(F.desc("window_id"))  # over at most ``baseline_windows`` rows
    kept = closed.orderBy(F.desc("window_id")).limit(p["baseline_windows"])
    memory.write("closed", kept.select((-F.row_number().over(newest_first)).cast("bigint").alias("window_id"), "n"))
    return alerts


def _by_arrival(rows: DataFrame, taken_us: int | None) -> DataFrame:
    """Times as they count in the order of arrival: none is before one that came earlier."""
    chunk = slice_start(F.col("seq"), _ARRIVAL_CHUNK).alias("_chunk")
    at = Window.partitionBy("_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    floors = rows.groupBy(chunk).agg(F.max("ts_us").alias("_max")).withColumn("_floor", F.max("_max").over(earlier))
    placed = rows.withColumn("_chunk", chunk).join(floors.select("_chunk", "_floor"), "_chunk")
    raised = F.greatest(F.max("ts_us").over(at), F.col("_floor"), F.lit(taken_us).cast("bigint"))
    return placed.withColumn("ts_us", raised).drop("_chunk", "_floor")
