"""Intermediate tables in the shared checkpoint folder.

The cooldown and the anchored windows need several passes over a small derived
table. Writing that table once cuts the lineage, survives the loss of an
executor, and gives Spark true file sizes, so that every later join picks its
strategy (broadcast or shuffle) from a measured size.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPE = threading.local()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or the one named by ``spark.checkpoint.dir``; set here only for a local master without either."""
    java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java_dir.isDefined():
        return java_dir.get().rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="wiretide-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _prefix(spark: SparkSession) -> str:
    return f"wiretide-{spark.sparkContext.applicationId}-"


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    path = f"{scratch_dir(spark)}/{_prefix(spark)}{uuid.uuid4().hex}"
    made = getattr(_SCOPE, "made", None)
    if made is not None:
        made.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and return a scan of it."""
    path = scratch_path(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables that this thread made inside; nothing may read them later."""
    outer, _SCOPE.made = getattr(_SCOPE, "made", None), []
    try:
        yield
    finally:
        made, _SCOPE.made = _SCOPE.made, outer
        for path in made:
            _delete(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, for when its results have been written."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(root):
        for status in files.listStatus(root):
            if status.getPath().getName().startswith(_prefix(spark)):
                files.delete(status.getPath(), True)
