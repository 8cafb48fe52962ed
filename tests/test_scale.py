"""Sums that stay on executors, lists that are pruned, distances far from the origin, and work off the lock."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillvec import errors
from rillvec.operators import exact, ivf, merge, metrics, mutate, whitening
from rillvec.plans import concurrent, durable, harness, reduce
from rillvec.sources import settings

RNG = np.random.default_rng(7)


def frame(spark, x, names="doc_id long, x array<double>"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], names)


def test_what_reaches_the_driver_does_not_grow_with_tasks(spark, monkeypatch):
    x = RNG.normal(size=(400, 8))
    model = ivf.IvfModel(x[:4].copy(), x[:16].reshape(16, 2, 4).transpose(1, 0, 2).copy())
    rows_seen = []
    collect = reduce.summed

    def counting(parts, keys, width):
        out = collect(parts, keys, width)
        rows_seen.append(out.count())
        return out

    monkeypatch.setattr(reduce, "summed", counting)
    for parts in (1, 64):
        df = frame(spark, x).repartition(parts)
        centres = ivf.kmeans(df, 4, 2, start=x[:4])
        m = whitening.moments(df)
        sums = mutate.batch_sums(df, model)
        books = ivf.pq_rounds(df, model.centroids, model.codebooks, 2)
        if parts == 1:
            want = (centres, m, sums, books)
    half = len(rows_seen) // 2
    assert rows_seen[:half] == rows_seen[half:]
    assert np.allclose(want[0], centres) and np.allclose(want[1].covariance, m.covariance) and np.allclose(m.covariance, np.cov(x.T, bias=True))
    assert np.array_equal(want[2].n, sums.n) and np.allclose(want[2].total, sums.total) and np.isclose(want[2].nqe, sums.nqe) and np.allclose(want[3], books)
    direct = mutate.sums(x, ivf.nearest(x, model.centroids)[0], None, model)
    for name in ("n", "total", "err", "sub_err", "sub_energy", "ratio_sum", "rows"):
        assert np.allclose(getattr(direct, name), getattr(sums, name)), name


def test_codebooks_use_every_row_wherever_they_are_fitted(spark, monkeypatch):
    x = RNG.normal(size=(600, 8))
    df = frame(spark, x)
    here = ivf.train(df, 4, 2, 4, iterations=4)
    monkeypatch.setattr(ivf, "LOCAL_ROWS", 0)
    there = ivf.train(df, 4, 2, 4, iterations=4)
    assert np.allclose(here.codebooks, there.codebooks) and np.allclose(here.centroids, there.centroids)
    assert not np.allclose(ivf.train(df, 4, 2, 4, iterations=4, sample=50).codebooks, there.codebooks)


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6])
def test_distances_far_from_the_origin(spark, offset):
    x = offset + 0.01 * RNG.normal(size=(3000, 16))
    q, centres = x[:40] + 0.001 * RNG.normal(size=(40, 16)), x[100:160]
    direct = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    got = exact.exact_topk(frame(spark, x), frame(spark, q, "query_id long, q array<double>"), 10).collect()
    want = {(i, int(j)) for i, row in enumerate(direct) for j in np.lexsort((np.arange(len(row)), row))[:10]}
    assert {(r.query_id, r.doc_id) for r in got} == want
    assert np.array_equal(ivf.nearest(x, centres)[0], ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1))


def test_lists_that_no_query_probes_are_not_read(spark):
    x = np.concatenate([c + 0.1 * RNG.normal(size=(50, 4)) for c in np.eye(4) * 100])
    df = frame(spark, x)
    for model in (ivf.IvfModel(np.eye(4) * 100), ivf.train(df, 4, 2, 4, iterations=2, centroids=np.eye(4) * 100)):
        held = ivf.postings_of(ivf.encode(df, model))
        laid = durable.durable(held if model.is_pq else ivf.with_vectors(held, df), "laid", by="list_id")
        q = frame(spark, x[50:53], "query_id long, q array<double>")
        found = (ivf.adc_candidates(model, laid, q, 5, 1) if model.is_pq else ivf.flat_candidates(model, laid, df, q, 5, 1)).toDF("query_id", "doc_id", "list_id", "approx")
        assert found.where("doc_id < 50 or doc_id >= 100").count() == 0 and found.count() >= 15
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ (IN|=|INSET)[^\]]*1", plan), plan
        if not model.is_pq:
            assert "Exchange" not in plan and "Join" not in plan
        assert {r.list_id for r in ivf.planned(laid, np.array([[False, True, False, False]])).select("list_id").distinct().collect()} == {1}


def test_percentiles_in_slices(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SLICES", 8)
    values = np.round(RNG.gamma(2.0, 20.0, size=2000), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    qs = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = metrics.percentiles(df, "v", qs).first()
    assert np.allclose(list(got), np.quantile(values, qs))
    floor = metrics.percentiles(df, "v", qs, "floor").first()
    assert np.allclose(list(floor), np.quantile(values, qs, method="lower"))
    assert list(metrics.percentiles(df.where("v is null"), "v", [0.5]).first()) == [None]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://head:7077", "x"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(errors.FailedPrecondition):
            durable.durable_dir(Session())


def _engine(spark, n=200, **changes):
    rows = durable.durable(frame(spark, RNG.normal(size=(n, 8)).astype(np.float32)))
    q = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    return harness.Engine(spark, rows, q, harness.demo_settings(n, pq_m=4, pq_nbits=3, **changes))


def test_a_merge_is_refused_when_the_index_moved_on(spark):
    e = _engine(spark)
    e.bootstrap(120)
    e.ingest(160)
    e.freeze("test")
    ready = e.prepare_merge()
    e.main.state = harness.replace(e.main.state, generation=e.main.state.generation + 1)
    with pytest.raises(errors.Unavailable):
        e.finish_merge(ready, "test")
    assert e.frozen is not None and e.main.rows == 120
    with pytest.raises(errors.Unavailable):
        merge.merge(e.main.postings, e.frozen.postings, e.vectors, e.main.model, generation=3, live=lambda: 4)
    assert e.commit_merge("again").rows == 40 and e.frozen is None and e.main.postings.count() == 160


def test_inserts_commit_during_a_merge(spark):
    """The second batch sets off a merge; the third is in, and published, before that merge commits."""
    e = _engine(spark, 240, stream_batch_size=20, merge_trigger_rows=21, main_index_rows=120, concurrent_workload_enable=True)
    service = concurrent.Service(e)
    seen = []

    def wait():
        deadline = service.now + 60_000
        while len(service.batches) < 3 and service.now < deadline:
            concurrent.time.sleep(0.02)
        if not seen:
            seen.append((len(service.batches), service._published.version, e.frozen is not None, e.main.rows))

    service.during_merge = wait
    service.run(240, query_rounds=1)
    assert seen[0][0] >= 3 and seen[0][1] >= 3 and seen[0][2] and seen[0][3] == 120
    assert service.batch_table().agg(F.max("end_row")).first()[0] == 240
    held = service.engine.shards()
    assert sorted(r[0] for s in held for r in s.postings.select("doc_id").collect()) == list(range(240))
    assert any(x["kind"] == "merge" for x in e.events)


def test_a_service_rebuilds_main(spark):
    e = _engine(spark, 200, stream_batch_size=20, merge_trigger_rows=21, main_index_rows=100, enable_global_rebuild=True, global_rebuild_max_count=1, global_rebuild_force_main_rows=10)
    service = concurrent.Service(e).run(200, query_rounds=1)
    assert e.rebuilds == 1 and any(x["kind"] == "rebuild" for x in e.events)
    assert sorted(r[0] for s in e.shards() for r in s.postings.select("doc_id").collect()) == list(range(200))
    assert service.recall("completed").agg(F.min("recall")).first()[0] >= 0


def test_flat_engines_scan_vectors_beside_their_lists(spark):
    e = _engine(spark, 100, pq_enable=False, exact_rerank_enable=False)
    e.bootstrap(60)
    e.ingest(100)
    plan = e.search(5, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert all(s.scan is not None and "x" in s.scan.columns for s in e.shards())
    got = {(r.query_id, r.doc_id) for r in e.search(5, 8).collect()}
    assert got == {(r.query_id, r.doc_id) for r in e.truth(5).collect()}


def test_options_without_effect_are_named():
    s = settings.parse('{"concurrent_insert_threads": 3, "nprobe": 4, "enable_latency_debug": true}')
    assert settings.without_effect(s) == ["concurrent_insert_threads", "enable_latency_debug"]
    assert set(settings.NO_EFFECT) <= set(vars(settings.Settings()))
