"""Rows of one list and code have one approximate distance; their order is that of their ids."""

import duckdb
import numpy as np
import pytest

from rillvec import catalog
from rillvec.operators import ivf

SF = "/root/testdata/sf0.001"
SUM = ")) AS approx FROM p JOIN n"


def test_columns_add_a_code_in_its_order_whatever_spills(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    q = rows.where("doc_id % 40 = 0").selectExpr("doc_id AS query_id", "x AS q")
    model = ivf.IvfModel(x[:2], 0.5 * x[:2].reshape(2, 8, 2).transpose(1, 0, 2))
    held = ivf.postings_of(ivf.encode(rows, model))
    code = {r.doc_id: (r.list_id, *r.code) for r in held.collect()}
    # Aggregation maps that fill up and spill every few hundred rows, as on larger tables.
    spark.conf.set("spark.sql.TungstenAggregate.testFallbackStartsAt", "3,501")
    try:
        got = ivf.adc_columns(model, held, q, 400, 2).collect()
    finally:
        spark.conf.unset("spark.sql.TungstenAggregate.testFallbackStartsAt")
    assert len(got) == 400 * 10
    approx = {}
    for r in got:
        approx.setdefault((r.query_id, code[r.doc_id]), []).append((r.rank, r.doc_id, r.approx))
    assert max(map(len, approx.values())) > 2
    for same in approx.values():
        assert len({a for _, _, a in same}) == 1 and [d for _, d, _ in sorted(same)] == sorted(d for _, d, _ in same)


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest embeddings four times over, with shifted keys: every code is held by four rows or more."""
    d = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(vec_id + 500 * i AS BIGINT) AS vec_id) FROM '{SF}/embeddings.parquet', range(4) AS r(i)) TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["adc_search", "adc_search_precomputed", "adc_search_columns", "rerank_search", "miss_diagnosis"])
def test_ties_match_sql_that_adds_in_order(spark, copies, name):
    """The registered SQL leaves open in which order sum() adds doubles; with that order fixed, and nothing else, no row differs."""
    sql = catalog.ORACLES[name]
    assert sql.count(SUM) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{copies}/embeddings.parquet'")
    want = con.execute(sql.replace(SUM, ") ORDER BY n.m) AS approx FROM p JOIN n")).df()
    got = catalog.QUERIES[name](spark, copies).toPandas()[list(want.columns)]
    assert sorted(np.round(got.to_numpy(float), 6).tolist()) == sorted(np.round(want.to_numpy(float), 6).tolist())
