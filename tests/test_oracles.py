"""Every query with SQL gives the rows that DuckDB finds."""

import math
import os

import duckdb
import pandas as pd
import pytest

from atomweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return format(float(v), ".6g")
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["x5_matching_centrosymmetry", "a6_csp_histogram", *"j1_cutoff_neighbors a1_coordination a2_rdf j2_knn x4_centrosymmetry x1_clusters a3_cluster_sizes x2_displacements a7_displacement_summary g8_workflow_coordination".split()])
def test_every_frame_is_read(spark, duck, name):
    frames = duck.execute("SELECT count(DISTINCT f) FROM (SELECT min(year(l_shipdate)) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)").fetchone()[0]
    assert registry.QUERIES[name](spark, SF).select("frame").distinct().count() == frames > 1


def test_exposures_of_many_event_types(spark, tmp_path):
    kinds = [f"kind{i}" for i in range(130)]
    rows = [("2024-01-01 10:00:00", k) for k in kinds] + [("2024-01-02 10:00:00", "kind5")]
    made = spark.createDataFrame(rows, "ts string, event_type string")
    made.selectExpr("cast(ts as timestamp) as ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.day, r.event_type): r.n for r in registry.QUERIES["j10_frame_exposures"](spark, str(tmp_path)).collect()}
    assert len(got) == 260 and sum(got.values()) == 131 and got["2024-01-02", "kind5"] == 1
