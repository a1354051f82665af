"""Tumbling windows that start at the first packet, their baseline and their top source.

A packet at least ``W`` after the start of the open window closes it and starts
the next one. Starts are thus a greedy chain over the distinct packet times
(see ``chain``) and not epoch-aligned; a quiet stretch adds no empty window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flags import has_text
from ..functions.timing import slice_start, window_us
from ..scratch import materialize
from .chain import FOLD_ROWS, SPAN_GAPS, SPAN_ROWS, fold_times, greedy_times, span_gaps_for
from .running import dense_index

# Consecutive windows that one task numbers or averages over.
_CHUNK = 65_536
_SPAN = "struct<start: bigint, end: bigint>"


def window_starts(packets: DataFrame, window_s: float, span_gaps: int = SPAN_GAPS, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Start times ``window_start`` of all windows (one chain for each value of ``by``), in the scratch folder.

    ``rows`` is a bound of the packets, where one is known: few are passed over once.
    """
    window, by = window_us(window_s), by or []
    times = packets.select(*by, F.col("ts_us").alias("u"))
    if rows is not None and rows <= FOLD_ROWS:
        return materialize(fold_times(times, by, window).select(*by, F.col("u").alias("window_start")))
    densest = times.groupBy(*by, slice_start(F.col("u"), window)).count().agg(F.max("count")).first()[0] or 0
    gaps = span_gaps_for(densest, span_gaps)
    if densest * gaps > SPAN_ROWS:
        # A burst: then a span is bounded by its microseconds. Otherwise equal times do no harm and save a shuffle.
        times = times.distinct()
    starts = greedy_times(times, by, window, lift_first=True, span_gaps=gaps)
    return materialize(starts.select(*by, F.col("u").alias("window_start")))


def assign_windows(packets: DataFrame, starts: DataFrame, window_s: float, close: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds ``window_start`` to each packet by an equi-join on time slices of the window's length.

    Starts are at least ``W`` apart, so a slice of length ``W`` holds at most
    one; a packet belongs to that one or to the one in the slice before. All
    starts must be given, or a selection with the column ``close``, the time of
    the packet that closed the window; packets outside the selection are dropped.
    """
    window, by = window_us(window_s), by or []
    own = slice_start(F.col("window_start"), window)
    end = F.col(close) if close else F.lit(None).cast("bigint")
    span = F.struct(F.col("window_start").alias("start"), end.alias("end"))
    slots = F.array(
        F.struct(own.alias("_slice"), span.alias("_own"), F.lit(None).cast(_SPAN).alias("_prior")),
        F.struct((own + F.lit(window)).alias("_slice"), F.lit(None).cast(_SPAN).alias("_own"), span.alias("_prior")),
    )
    lookup = starts.select(*by, F.inline(slots)).groupBy(*by, "_slice")
    lookup = lookup.agg(F.max("_own").alias("_own"), F.max("_prior").alias("_prior"))
    placed = packets.withColumn("_slice", slice_start(F.col("ts_us"), window)).join(lookup, [*by, "_slice"])
    chosen = F.when(F.col("ts_us") >= F.col("_own.start"), F.col("_own")).otherwise(F.col("_prior"))
    placed = placed.withColumn("_span", chosen).drop("_slice", "_own", "_prior")
    if close:
        placed = placed.filter(F.col("ts_us") < F.col("_span.end"))
    return placed.withColumn("window_start", F.col("_span.start")).drop("_span")


def anchored_windows(
    packets: DataFrame, window_s: float, starts: DataFrame | None = None, weight: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """One row per window, the last open one included. A row counts as ``weight`` packets, or as one. ``by``: a chain for each value.

    Columns: ``window_id`` (0, 1, ...), ``window_start``, ``n``, ``first_seq``
    and, NULL for the open window, ``close_us`` and ``close_seq`` of the packet
    that closed it.
    """
    by = by or []
    starts = window_starts(packets, window_s, by=by) if starts is None else starts
    number = F.col(weight) if weight else F.lit(1).cast("bigint")
    members = assign_windows(packets.select(*by, "ts_us", "seq", number.alias("_weight")), starts, window_s, by=by)
    # One row per window, read several times below; the packets are read once.
    counted = materialize(
        members.groupBy(*by, "window_start").agg(
            F.sum("_weight").alias("n"), F.min(F.struct("ts_us", "seq"))["seq"].alias("first_seq")
        )
    )
    chunk = slice_start(F.col("window_start"), _CHUNK * window_us(window_s))
    numbered = dense_index(counted, ["window_start"], chunk, "window_id", by=by)
    return _neighbours(
        numbered,
        behind=0,
        add=lambda at: {
            "close_us": F.lead("window_start").over(at),
            "close_seq": F.lead("first_seq").over(at),
        },
        by=by,
    ).select(*by, "window_id", "window_start", "n", "first_seq", "close_us", "close_seq")


def _neighbours(windows: DataFrame, behind: int, add, by: list[str] | None = None) -> DataFrame:
    """Window expressions over dense ids in bounded chunks.

    Each chunk also gets the ``behind`` ids before it and the one after it.
    """
    size = max(_CHUNK, behind)
    own = slice_start(F.col("window_id"), size)
    from_chunk = slice_start(F.col("window_id") - F.lit(1), size)
    to_chunk = slice_start(F.col("window_id") + F.lit(behind), size)
    spread = windows.select("*", F.explode(F.array_distinct(F.array(from_chunk, own, to_chunk))).alias("_chunk"))
    at = Window.partitionBy(*(by or []), "_chunk").orderBy("window_id")
    return spread.select("*", *[c.alias(n) for n, c in add(at).items()]).filter(F.col("_chunk") == own).drop("_chunk")


def rolling_baseline(windows: DataFrame, baseline_windows: int = 6, by: list[str] | None = None) -> DataFrame:
    """Adds ``baseline_avg`` and ``baseline_n`` over the ``baseline_windows`` windows before each one."""

    def trailing(at):
        before = at.rowsBetween(-baseline_windows, -1)
        return {"baseline_avg": F.avg("n").over(before), "baseline_n": F.count("n").over(before)}

    return _neighbours(windows, baseline_windows, trailing, by)


def top_source_per_window(members: DataFrame, window: str = "window_start", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``window, top_ip, top_count``: most packets, then first seen; ``unknown`` and 0 without any source.

    Takes packets with their window. Counting per source combines before the
    shuffle, and the maximum is a plain aggregate, so a busy window or source
    is never collected.
    """
    by = by or []
    arrival = F.min(F.struct("ts_us", "seq"))
    number = F.sum(weight) if weight else F.count(F.lit(1))
    per_source = members.groupBy(*by, window, "src_ip").agg(number.alias("_n"), arrival.alias("_first"))
    rank = F.struct(
        F.col("_n"), (-F.col("_first.ts_us")).alias("_ts"), (-F.col("_first.seq")).alias("_seq"), F.col("src_ip").alias("_ip")
    )
    best = F.max(F.when(has_text(F.col("src_ip")), rank)).alias("_best")
    return per_source.groupBy(*by, window).agg(best).select(
        *by,
        window,
        F.coalesce("_best._ip", F.lit("unknown")).alias("top_ip"),
        F.coalesce("_best._n", F.lit(0).cast("bigint")).alias("top_count"),
    )


def aligned_windows(packets: DataFrame, window_s: float, watermark: str | None = None) -> DataFrame:
    """``window_start, n``: packets per window of the epoch's grid, for tables and, with a ``watermark``, for streams.

    Not what the detector does, whose windows start at the first packet. These need no chain: a stream keeps one number per
    open window and gives each window once, when the watermark has passed it.
    """
    rows = packets.withWatermark("event_time", watermark) if watermark else packets
    counted = rows.groupBy(F.window("event_time", f"{window_us(window_s)} microseconds")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_micros("window.start").alias("window_start"), "n")
