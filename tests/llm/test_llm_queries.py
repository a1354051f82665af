"""The queries that SQL can express against their SQL, and the pipeline on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from wiretide.llm.registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_names():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark):
    """Each stage keeps the documents' columns; what is left is one document of each group, packed whole."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frame = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialize(stage(spark, frame, SF_DIR))
        assert frame.columns == docs.columns
        left[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    assert left["jaccard_join"] <= left["language_id"] <= left["quality_classifier"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()
    good = {r.doc_id for r in labels}
    assert len(good & left["language_id"]) > 0.98 * len(good)
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left["mixing"]
