"""Every registered engine query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from rillvec import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(frame):
    def text(v):
        if v is None or v != v:
            return "-"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_trained_index_reaches_the_recall_floor(spark):
    got = {r.nprobe: r.recall for r in catalog.QUERIES["trained_search_recall"](spark, SF).collect()}
    assert got[16] >= 0.95 and got[12] >= 0.9 and got[1] <= got[4] <= got[8] <= got[12] + 1e-9


@pytest.mark.parametrize("name", ["trained_flat_search", "trained_adc_search", "trained_rerank_search", "trained_multi_route_search"])
def test_trained_searches_reach_the_recall_floor(spark, name):
    table = catalog.base(spark, SF).toPandas()
    ids, x = table["doc_id"].to_numpy(), np.array(table["x"].tolist(), dtype=np.float64)
    truth = {(int(q), int(i)) for q, v in zip(ids, x) if q % 100 == 0 for i in ids[np.lexsort((ids, ((x - v) ** 2).sum(axis=1)))[:10]]}
    found = {(r.query_id, r.doc_id) for r in catalog.QUERIES[name](spark, SF).collect()}
    assert len(found & truth) >= 0.9 * len(truth)


def test_runs_reach_the_recall_floor(spark):
    for name in ("stream_run", "workload_run"):
        assert all(r.recall >= 0.9 for r in catalog.QUERIES[name](spark, SF).collect())


def test_merge_balanced_covers_every_row_once(spark):
    ids = [r.doc_id for r in catalog.QUERIES["merge_balanced"](spark, SF).collect()]
    assert sorted(ids) == list(range(500))
