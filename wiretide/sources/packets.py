"""Packet tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import MICROS
from ..operators.running import sorted_index
from ..schema import PACKET_COLUMNS, PACKET_FIELDS

FORMATS = ("parquet", "orc", "json", "csv")

_DEFAULTS = {"is_arp": False, "length": 0}


def load_packets(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    streaming: bool = False,
    between: tuple[int, int] | None = None,
    **options: str,
) -> DataFrame:
    """Packet records from files, with the table's partition columns.

    ``between`` (from, to: epoch microseconds, the second excluded) is compared with the table's own time column, so
    that it reaches the scan. Streams need a ``seq`` column, since only the writer knows the arrival order.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {list(FORMATS)}")
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if streaming or fmt in ("json", "csv"):
        reader = reader.schema(T.StructType([T.StructField("seq", T.LongType()), *PACKET_FIELDS.fields]))
    rows = reader.load(path)
    if between is None:
        return as_packets(rows)
    low, high = between
    if "ts_us" in rows.columns:
        return as_packets(rows.filter((F.col("ts_us") >= F.lit(low)) & (F.col("ts_us") < F.lit(high))))
    # Times are rounded to microseconds: one to each side, and the exact comparison after it.
    near = (F.col("ts") >= F.lit((low - 1) / MICROS)) & (F.col("ts") <= F.lit((high + 1) / MICROS))
    return as_packets(rows.filter(near & (_micros(rows) >= F.lit(low)) & (_micros(rows) < F.lit(high))))


def _micros(df: DataFrame) -> Column:
    return F.col("ts_us") if "ts_us" in df.columns else F.round(F.col("ts") * F.lit(float(MICROS))).cast("bigint")


def number_arrivals(df: DataFrame) -> DataFrame:
    """A table with ``ts`` or ``ts_us`` and a dense arrival number ``seq``: 0, 1, 2, ... in the order of time.

    Rows of one time are in the order of a hash of the row, whatever the file layout; equal rows follow each other. Rows without
    a time come first. The table is written to the scratch folder once, cut into ranges of (time, hash, place in the input), so neither a time with
    a third of all rows nor a flood of equal rows ends up in one task.
    """
    if df.isStreaming:
        raise ValueError("a packet stream needs a seq column")
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = {"_time": _micros(df), "_hash": row_hash, "_place": F.monotonically_increasing_id()}
    return sorted_index(df.withColumns(keys), list(keys), "seq").drop(*keys)


def as_packets(df: DataFrame) -> DataFrame:
    """Brings a table with at least ``ts`` (epoch seconds) or ``ts_us`` to the packet schema.

    Missing columns get their defaults, existing ones pass unchanged, so filters on them still reach the scan, and further columns
    are kept. Detection fails on a row without a time (``timed``). A table without ``seq`` is numbered by ``number_arrivals``.
    """
    have = set(df.columns)
    if not have & {"ts", "ts_us"}:
        raise ValueError("packets need a ts column (epoch seconds) or a ts_us column (epoch microseconds)")
    further = [F.col(f"`{c}`") for c in df.columns if c not in PACKET_COLUMNS]
    if "seq" not in have:
        df = number_arrivals(df)
    known = _micros(df)
    columns = {
        "seq": F.col("seq").cast("bigint"),
        "ts": F.col("ts").cast("double") if "ts" in have else known / F.lit(float(MICROS)),
        "ts_us": known,
        "event_time": F.col("event_time") if "event_time" in have else F.timestamp_micros(known),
    }
    for field in PACKET_FIELDS:
        if field.name == "ts":
            continue
        if field.name not in have:
            columns[field.name] = F.lit(_DEFAULTS.get(field.name)).cast(field.dataType)
        elif df.schema[field.name].dataType == field.dataType:
            columns[field.name] = F.col(field.name)
        else:
            columns[field.name] = F.col(field.name).cast(field.dataType)
    return df.select(*[columns[name].alias(name) for name in PACKET_COLUMNS], *further)


def timed(packets: DataFrame) -> DataFrame:
    """The same packets; a row without a time fails the query. A condition of its own, so time filters still reach the scan."""
    return packets.filter(F.when(F.col("ts_us").isNull(), F.raise_error(F.lit("packet without a time")).cast("boolean")).otherwise(True))
