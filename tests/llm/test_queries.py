"""Corpus queries against DuckDB, and the pipeline against its stages' own promises."""

import os

import duckdb
import pytest

import corpus_pipeline
from atomweave.llm import queries
from tests.test_oracles import SF, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    tidy = lambda f: rows(f.astype(object).where(f.notna(), None))
    assert sorted(got.columns) == sorted(want.columns) and tidy(got) == tidy(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        if name != "mixing sources":
            assert 0 < docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
