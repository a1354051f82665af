"""Tables that a detector keeps from one micro-batch of a stream to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DONE = "done"


class Folder:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of its ``batch=`` folders, ascending."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[len("batch=") :]) for n in names if n.startswith("batch="))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._root.suffix(f"/{name}"))

    def drop(self, name: str) -> None:
        self._fs.delete(self._root.suffix(f"/{name}"), True)


class StreamMemory:
    """What one detector keeps. A micro-batch reads the tables of the last one that it finished, and writes its own.

    A micro-batch that is run again reads the same tables as before. One that failed leaves none: its rows are set aside, and the next
    micro-batch gets them together with its own.
    """

    def __init__(self, spark: SparkSession, path: str, batch_id: int, ordered: bool) -> None:
        self.spark, self.batch_id, self.ordered = spark, batch_id, ordered
        self.root, self.aside = Folder(spark, path), Folder(spark, f"{path}/aside")
        done = [b for b in self.root.batches() if b < batch_id and self.root.has(f"batch={b}/{_DONE}")]
        self.last = done[-1] if done else None
        self.spare = done[:-1]

    def read(self, name: str, schema: str) -> DataFrame:
        """The table as it was written before; empty at first."""
        if self.last is None or not self.root.has(f"batch={self.last}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root.path}/batch={self.last}/{name}")

    def write(self, name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.root.path}/batch={self.batch_id}/{name}")

    def with_rows_set_aside(self, rows: DataFrame) -> DataFrame:
        """``rows`` after those of the micro-batches that failed since the last one that was finished."""
        waiting = [b for b in self.aside.batches() if b < self.batch_id and (self.last is None or b > self.last)]
        if not waiting:
            return rows
        paths = [f"{self.aside.path}/batch={b}" for b in waiting]
        return self.spark.read.schema(rows.schema).parquet(*paths).unionByName(rows)

    def set_aside(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.aside.path}/batch={self.batch_id}")

    def finish(self) -> None:
        """The tables of this micro-batch count from now on; those before the last one are deleted."""
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root.path}/batch={self.batch_id}/{_DONE}")
        for b in self.spare:
            self.root.drop(f"batch={b}")
        for b in self.aside.batches():
            if self.last is not None and b <= self.last:
                self.aside.drop(f"batch={b}")
