"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as the word rule knows it: space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other characters than white space; null text gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.array_remove(parts, "")


def reuse_memory() -> None:
    """Lets a worker's arrays of up to 31 MB take the memory of earlier ones instead of new pages.

    The C library raises both its limits when a block of its own pages is freed: smaller blocks then come from the heap, which
    keeps twice that size. Elsewhere than with glibc this does nothing.
    """
    np.empty(31 << 20, np.uint8)


#: Rows that a task takes from a batch at a time, so that long texts don't add up in its memory.
PIECE_ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, in order."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to a dict of columns (or None)."""
    names = [f.name for f in _arrow_schema(schema)]
    types = [f.type for f in _arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, judge_of_task: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows whose text is kept, with all columns. ``judge_of_task`` makes, once per task, a function from texts to decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        for batch in pieces(batches):
            judge = judge or judge_of_task()
            yield batch.filter(pa.array(judge(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
    }
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])
