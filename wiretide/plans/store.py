"""The alert log: an append-only table, and the queries on it.

Each batch of each writer has a directory of its own, so no writer touches another one's alerts. Ids are reserved in the
folder ``_ids``: entry n, created only if nobody else has, says whose range it is and where the next one starts. An append
looks at the last entry and at none of the alerts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import iso_utc
from ..operators.predicates import filter_alerts
from ..schema import ALERT_SCHEMA, EVENT_TYPES
from ..scratch import materialize
from .engine import number_written

# Rows returned by default and at most, and the four known types in display order.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
CARD_TYPES = EVENT_TYPES

# Tenths of a second to wait for a reservation that another writer is making.
_PATIENCE = 100

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *ALERT_SCHEMA.fields,
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert log at ``path``; empty if nothing was written yet."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def append_alerts(
    alerts: DataFrame, path: str, batch_id: int | None = None, writer: str | None = None, lines_path: str | None = None
) -> int:
    """Numbers the alerts after all that were appended before and appends them, partitioned by writer, batch and date; returns their number.

    Writing the same ``batch_id`` of the same ``writer`` again replaces just that, with the same ids, so a replayed
    streaming batch leaves no duplicates. With ``lines_path`` the log lines are written there as text, in the order of ids, in a folder of the
    same name. Without a ``batch_id`` each call is a writer of its own. A failure between reserving ids and
    writing leaves a gap in the ids, and never a repeated one.
    """
    if batch_id is None:
        if writer is not None:
            raise ValueError("a named writer needs batch numbers")
        writer, batch_id = uuid.uuid4().hex, 0
    writer = writer or "batch"
    alerts = materialize(alerts)
    n = alerts.count()
    if not n:
        return 0
    ids = _Ids(alerts.sparkSession, path)
    numbered = number_written(alerts, ids.reserve(writer, batch_id, n)).select("id", *ALERT_SCHEMA.names)
    dated = numbered.withColumn("event_date", F.date_add(F.lit("1970-01-01").cast("date"), _utc_day()))
    folder = f"writer={writer}/batch_id={batch_id}"
    dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/{folder}")
    if lines_path:
        written = alerts.sparkSession.read.schema(LOG_SCHEMA).parquet(f"{path}/{folder}")
        alert_lines(written).orderBy("id").select("line").write.mode("overwrite").text(f"{lines_path}/{folder}")
    return n


class _Ids:
    """Reserved ranges of ids. Creating a file only if it isn't there is atomic on HDFS, and on local disks by the file's own call."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = f"{path}/_ids"
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(hadoop)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read(self, name: str) -> dict | None:
        if not self.fs.exists(self._path(name)):
            return None
        for _ in range(_PATIENCE):
            stream = self.fs.open(self._path(name))
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:
                return json.loads(text)
            time.sleep(0.1)  # another writer has made the file and not yet filled it
        raise RuntimeError(f"{self.root}/{name} is empty: its writer failed in between; delete it if none is running")

    def _create(self, name: str, entry: dict) -> bool:
        """Whether this call made the file."""
        path = self._path(name)
        if self.fs.getScheme() == "file":
            # Hadoop's local file system looks first and creates then, which two writers can do at once.
            self.fs.mkdirs(path.getParent())
            if not self.jvm.java.io.File(path.toUri().getPath()).createNewFile():
                return False
            stream = self.fs.create(path, True)
        else:
            try:
                stream = self.fs.create(path, False)
            except Py4JJavaError:
                if self.fs.exists(path):
                    return False
                raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True

    def _last(self) -> int:
        """Number of the last entry, -1 without any; entries have no gaps, so it is found in a few steps."""
        there = lambda k: self.fs.exists(self._path(f"{k:012d}"))
        if not there(0):
            return -1
        low, high = 0, 1
        while there(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return low

    def newest_first(self) -> Iterator[tuple[str, int]]:
        """The directories of the log with their numbers of alerts, from the one with the highest ids on; each once."""
        base, seen = self.root[: -len("/_ids")], set()
        for k in range(self._last(), -1, -1):
            entry = self._read(f"{k:012d}")
            folder = f"{base}/writer={entry['writer']}/batch_id={entry['batch_id']}"
            # A batch that failed before it was written has none.
            if folder not in seen and self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(folder)):
                yield folder, entry["n"]
            seen.add(folder)

    def reserve(self, writer: str, batch_id: int, n: int) -> int:
        """The first of ``n`` ids; the same as before for a batch that is written again."""
        own = f"{writer}/{batch_id}"
        known = self._read(own)
        if known and known["n"] >= n:
            return known["first"]
        k = self._last()
        while True:
            last = self._read(f"{k:012d}") if k >= 0 else {"first": 1, "n": 0}
            entry = {"writer": writer, "batch_id": batch_id, "first": last["first"] + last["n"], "n": n}
            k += 1
            if self._create(f"{k:012d}", entry):
                break
        if known:
            self.fs.delete(self._path(own), False)
        self._create(own, entry)
        return entry["first"]


def stream_writer(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint: the same after a restart, another for a new checkpoint."""
    return json.loads("".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def _utc_day() -> Column:
    return F.floor(F.col("ts_us") / F.lit(86_400_000_000)).cast("int")


def request_limit(limit: object = None) -> int:
    """The row limit of a request: missing, zero or non-integer means 100, and 1000 is the most.

    Negative limits, which would mean no limit at all, are rejected.
    """
    try:
        wanted = int(str(limit)) if limit is not None else DEFAULT_LIMIT
    except ValueError:
        wanted = DEFAULT_LIMIT
    if wanted < 0:
        raise ValueError("limit must not be negative")
    return min(wanted or DEFAULT_LIMIT, MAX_LIMIT)


def recent_events(
    alerts: DataFrame,
    limit: object = DEFAULT_LIMIT,
    event_type: str | None = None,
    source_ip: str | None = None,
    capped: bool = False,
) -> DataFrame:
    """The newest alerts by insertion order. ``capped`` applies ``request_limit``; 0 otherwise means none."""
    if capped:
        rows = request_limit(limit)
    else:
        rows = int(limit)
        if rows < 0:
            raise ValueError("limit must not be negative")
    return filter_alerts(alerts, event_type, source_ip).orderBy(F.desc("id")).limit(rows)


def newest_events(
    spark: SparkSession,
    path: str,
    limit: object = DEFAULT_LIMIT,
    event_type: str | None = None,
    source_ip: str | None = None,
    capped: bool = False,
) -> DataFrame:
    """``recent_events`` of the log at ``path``, from the directories that can hold the newest alerts only.

    The reserved ranges of ids tell, from the last one back, which batch has them. Without a filter they also tell how many batches are
    enough; with one, twice as many are read each time until enough alerts are found.
    """
    rows = request_limit(limit) if capped else int(limit)
    if rows < 0:
        raise ValueError("limit must not be negative")
    entries = _Ids(spark, path).newest_first()
    folders, held, step = [], 0, 1
    found = spark.createDataFrame([], LOG_SCHEMA)
    while True:
        added = []
        for folder, n in entries:
            added.append(folder)
            held += n
            if len(added) >= step and held >= rows:
                break
        folders += added
        if folders:
            read = spark.read.schema(LOG_SCHEMA).option("basePath", path).parquet(*folders)
            found = filter_alerts(read, event_type, source_ip).orderBy(F.desc("id")).limit(rows)
        if not added or not (event_type or source_ip) or found.count() >= rows:
            return found
        step = 2 * len(folders)


def event_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_events"))


def events_per_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stats(alerts: DataFrame) -> DataFrame:
    """One row: ``total_events`` and the map ``by_type``."""
    entry = F.struct("event_type", "n")
    return events_per_type(alerts).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_type"),
    )


def type_cards(alerts: DataFrame) -> DataFrame:
    """Zero-filled counts of the four known types, plus the total of all alerts as ``TOTAL``."""
    counted = stats(alerts)
    total = F.struct(F.lit("TOTAL").alias("card"), F.col("total_events").alias("n"))
    known = [
        F.struct(
            F.lit(t).alias("card"),
            F.coalesce(F.try_element_at("by_type", F.lit(t)), F.lit(0).cast("bigint")).alias("n"),
        )
        for t in CARD_TYPES
    ]
    return counted.select(F.inline(F.array(total, *known)))


def alerts_json(alerts: DataFrame) -> DataFrame:
    """Adds ``json``: id, ISO timestamp, source, type and details of each alert."""
    record = F.struct(
        "id", iso_utc(F.col("ts_us")).alias("timestamp"), "source_ip", "event_type", "details"
    )
    return alerts.withColumn("json", F.to_json(record))


def alert_lines(alerts: DataFrame) -> DataFrame:
    """Adds ``line``, the log line of each alert."""
    return alerts.withColumn(
        "line",
        F.concat(
            F.lit("ALERT ["),
            F.col("event_type"),
            F.lit("] source="),
            F.col("source_ip"),
            F.lit(" :: "),
            F.col("details"),
        ),
    )
