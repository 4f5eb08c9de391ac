"""Queries with SQL against DuckDB, the pipeline stage by stage, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tests.oracle import same
from tilewright.llm import queries
from tilewright.llm.common import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], FOLDER)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        counts.append(out.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    lower = lambda t: (t or "").encode().lower()
    assert out.count() == corpus_pipeline.run(spark, FOLDER).count()
    assert docs.select("doc_id").distinct().count() <= counts[3]
