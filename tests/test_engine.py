"""Hand-checked fixtures, twins of kernels, invariants, and refusals."""

import json
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillvec import errors
from rillvec.functions import vectors as vec
from rillvec.operators import exact, ivf, merge, metrics, mutate, routes, triggers, whitening
from rillvec.plans import harness
from rillvec.plans.durable import durable
from rillvec.sources import artifacts, fvecs, workload
from rillvec.sources import settings as options
from rillvec.streaming import ingest

X = "doc_id long, x array<float>"
QS = "query_id long, q array<float>"
POSTING = "shard string, list_id int, doc_id long, code array<short>"


def frame(spark, rows, schema=X):
    return spark.createDataFrame(rows, schema)


def cloud(spark, n, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return frame(spark, [(i, r.tolist()) for i, r in enumerate(x)])


@pytest.fixture(scope="module")
def six(spark):
    return frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [5.0, 5.0]), (4, [6.0, 5.0]), (5, [5.0, 7.0])])


@pytest.fixture(scope="module")
def two_queries(spark):
    return frame(spark, [(0, [1.0, 1.0]), (1, [3.0, 3.0])], QS)


CENTRES = np.array([[0.5, 0.5], [5.5, 5.5]])


def ids(df, order="rank"):
    out = {}
    for r in df.orderBy("query_id", order).collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


# --- search --------------------------------------------------------------


def test_exact_and_flat_search_by_hand(spark, six, two_queries):
    truth = exact.exact_topk(six, two_queries, 3)
    assert ids(truth) == {0: [1, 0, 2], 1: [3, 2, 1]}
    assert [r.dist for r in truth.where("query_id = 1").orderBy("rank").collect()] == [8.0, 10.0, 13.0]
    model = ivf.IvfModel(CENTRES)
    held = ivf.postings_of(ivf.encode(six, model))
    found = ivf.search_flat(model, held, six, two_queries, 3, 1)
    assert ids(found) == {0: [1, 0, 2], 1: [2, 1, 0]}
    assert {r.query_id: round(r.recall, 6) for r in metrics.recall_at_k(truth, found, 3).collect()} == {0: 1.0, 1: round(2 / 3, 6)}
    every = ivf.search_flat(model, held, six, two_queries, 3, 9)
    assert ids(every) == ids(truth)


def test_many_query_blocks_and_empty_inputs(spark, six, two_queries, monkeypatch):
    want = ids(exact.exact_topk(six, two_queries, 3))
    blocks = list(exact.query_blocks(two_queries, 1))
    assert len(blocks) == 2
    assert ids(exact.exact_topk(six, two_queries, 3, seen_rows=3)) == {0: [1, 0, 2], 1: [2, 1, 0]}
    assert want[0] == [1, 0, 2]
    assert exact.exact_topk(six, two_queries.where("1 = 0"), 3).count() == 0
    assert exact.exact_topk(six.where("1 = 0"), two_queries, 3).count() == 0
    monkeypatch.setattr(exact, "QUERY_BLOCK", 1)
    with pytest.raises(errors.InvalidArgument):
        exact.exact_topk_columns(six, two_queries, 3)
    with pytest.raises(errors.InvalidArgument):
        exact.exact_topk(six, two_queries, 0)


def test_kernel_and_columns_agree_with_ties(spark):
    rng = random.Random(0)
    rows = frame(spark, [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)]).repartition(5)
    q = frame(spark, [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(20)], QS)
    assert sorted(exact.exact_topk(rows, q, 7).select("query_id", "doc_id", "dist", "rank").collect()) == sorted(exact.exact_topk_columns(rows, q, 7).select("query_id", "doc_id", "dist", "rank").collect())


def test_frontiers_hold_only_real_rows(spark, six, two_queries):
    got = exact.frontier_topk(six, two_queries, 3, [2, 6])
    assert ids(got.where("frontier = 2")) == {0: [1, 0], 1: [1, 0]} and ids(got.where("frontier = 6")) == {0: [1, 0, 2], 1: [3, 2, 1]}


def test_adc_by_hand():
    book = np.array([[[-1.0], [1.0]], [[0.0], [2.0]]])
    table = ivf.lookup_tables(np.array([[3.0, 2.0]]), np.array([1.0, 1.0]), book)[0]
    assert table[0, 1] + table[1, 0] == 2.0
    constant, pre = ivf.precomputed_tables(np.array([[3.0, 2.0]]), np.array([1.0, 1.0]), book)
    assert constant[0] == 5.0 and constant[0] + pre[0, 0, 1] + pre[0, 1, 0] == 2.0


@pytest.mark.parametrize("residual", [True, False])
def test_adc_kernel_and_columns_agree(spark, residual):
    rows = cloud(spark, 300)
    model = ivf.train(rows, 6, 4, 3, iterations=4, residual=residual)
    held = ivf.postings_of(ivf.encode(rows, model))
    q = rows.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    a = {(r.query_id, r.doc_id): round(r.approx, 6) for r in ivf.search_adc(model, held, q, 10, 3).collect()}
    b = {(r.query_id, r.doc_id): round(r.approx, 6) for r in ivf.adc_columns(model, held, q, 10, 3).collect()}
    c = {(r.query_id, r.doc_id): round(r.approx, 6) for r in ivf.search_adc(model, held, q, 10, 3, precomputed=True).collect()}
    assert a == b == c and len(a) == 100


def test_rerank_of_everything_is_exact(spark):
    rows = cloud(spark, 200)
    q = rows.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    model = ivf.train(rows, 4, 2, 2, iterations=3)
    route = routes.Route("main", model, ivf.postings_of(ivf.encode(rows, model)), 0)
    assert ids(routes.search([route], rows, q, 10, 4, shared_budget=200)) == ids(exact.exact_topk(rows, q, 10))
    with pytest.raises(errors.InvalidArgument):
        routes.search([route], rows, q, 10, 4, shared_budget=5)
    assert routes.candidate_budget(0, 7) == 7 and routes.candidate_budget(3, 7) == 3


def test_dedupe_keeps_the_nearer_then_the_older(spark):
    rows = frame(spark, [(0, 1, 2.0, 1, "a"), (0, 1, 2.0, 0, "m"), (0, 2, 1.0, 1, "a"), (0, 2, 3.0, 0, "m")], "query_id long, doc_id long, approx double, from_new int, route string")
    assert {(r.doc_id, r.from_new) for r in routes.dedupe(rows).collect()} == {(1, 0), (2, 1)}


def test_searcher(spark, six, two_queries):
    model = ivf.IvfModel(CENTRES)
    s = ivf.Searcher()
    with pytest.raises(errors.FailedPrecondition):
        s.search(two_queries, 3, 1)
    s.set_index(model, ivf.postings_of(ivf.encode(six, model)), six)
    got = s.search(two_queries, 3, 2)
    assert ids(got) == {0: [1, 0, 2], 1: [3, 2, 1]} and {r.from_new for r in got.collect()} == {1}


# --- training ------------------------------------------------------------


def test_kmeans_rounds_match_numpy(spark):
    rows = durable(cloud(spark, 120, 4).repartition(6))
    x = np.array([r.x for r in rows.orderBy("doc_id").collect()], dtype=np.float64)
    assert np.allclose(ivf.kmeans(rows, 5, 6), ivf.local_kmeans(x, 5, 6))


def test_kmeans_with_more_clusters_than_rows_and_empty_ones(spark):
    rows = frame(spark, [(0, [0.0]), (1, [0.0]), (2, [9.0])])
    assert ivf.kmeans(rows, 5, 2).shape == (5, 1) and np.isfinite(ivf.kmeans(rows, 5, 2)).all()
    with pytest.raises(errors.InvalidArgument):
        ivf.kmeans(rows.where("1 = 0"), 2)
    assert ivf.train(rows, 10, iterations=1).nlist == 3
    for m, bits in ((3, 8), (1, 9), (0, 0)):
        with pytest.raises(errors.InvalidArgument):
            ivf.check_pq(8, m, bits)


def test_pq_expressions(spark):
    df = spark.createDataFrame([([1, 0], [[[0.0], [2.0]], [[1.0], [3.0]]], [[0.5, 1.5], [2.5, 3.5]])], "codes array<short>, book array<array<array<double>>>, lut array<array<double>>")
    vec.register(spark)
    assert df.select(vec.pq_decode("codes", "book"), vec.adc("lut", "codes")).first()[:] == ([2.0, 1.0], 4.0)
    assert df.selectExpr("pq_decode(codes, book)", "adc(lut, codes)").first()[:] == ([2.0, 1.0], 4.0)


# --- metrics -------------------------------------------------------------


def test_percentiles_and_imbalance_by_hand(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    a, b = metrics.summary(df, "v").first(), metrics.summary(df, "v", "floor").first()
    assert (a.p50, round(a.p99, 6)) == (2.5, 3.97) and (b.p50, b.p99) == (2, 3)
    sizes = spark.createDataFrame([(0, 4), (1, 0), (2, 2)], "list_id int, n long")
    assert metrics.imbalance(sizes).first().imbalance == 2.0
    assert round(metrics.imbalance(sizes, "nonempty").first().imbalance, 6) == 1.333333
    assert metrics.imbalance(sizes, "gated", 7).first().imbalance == 0.0 and metrics.imbalance(sizes.where("1 = 0")).first().imbalance == 0.0
    for f in (lambda: metrics.summary(df, "v", "other"), lambda: metrics.imbalance(sizes, "other")):
        with pytest.raises(errors.InvalidArgument):
            f()


def test_recall_divides_by_k(spark):
    truth = spark.createDataFrame([(0, i) for i in range(3)], "query_id long, doc_id long")
    found = spark.createDataFrame([(0, i, i + 1) for i in range(3)], "query_id long, doc_id long, rank int")
    assert metrics.mean_recall(truth, found, 10).first().recall == pytest.approx(0.3)
    age = metrics.age_recall(truth, found.where("doc_id < 2"), 2, 3).first()
    assert (age.recall_new, age.recall_old) == (0.0, 1.0) and metrics.age_recall(truth, found, 3, 3).first().recall_new == 0.0


def test_misses_add_up(spark):
    rows = cloud(spark, 300)
    q = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    model = ivf.train(rows, 8, 2, 2, iterations=3)
    held = ivf.postings_of(ivf.encode(rows, model))
    trace = ivf.adc_candidates(model, held, q, 5, 2, trace=True).join(rows, "doc_id").join(q, "query_id").select("query_id", "doc_id", "approx", vec.l2sq("q", "x").alias("exact"))
    got = metrics.miss_diagnosis(exact.exact_topk(rows, q, 5), ivf.search_adc(model, held, q, 5, 2), trace).collect()
    assert all(r.gt == 5 and r.hits + r.not_probed + r.filtered == 5 and r.rank_loss >= 0 and r.exact_hits == r.probed for r in got) and any(r.filtered for r in got)


def test_other_tables(spark):
    lat = spark.createDataFrame([(i, float(i % 7), 10.0 * i) for i in range(30)], "query_id long, latency_ms double, completion_ms double")
    assert [r.query_id for r in metrics.slowest_queries(lat, 2).collect()] == [6, 13]
    buckets = {r.bucket: r for r in metrics.latency_buckets(lat, 250.0).collect()}
    assert buckets[0].n == 20 and buckets[1].n == 10 and buckets[1].qps == pytest.approx(200.0)
    b = spark.createDataFrame([(10, 1.0, 1.0)], "rows int, update_s double, maintenance_s double")
    assert metrics.update_throughput(b).first()[:] == (10.0, 5.0) and metrics.throughput(5, 0) == 0.0


# --- transforms ----------------------------------------------------------


def test_transform_by_hand(spark):
    rows = frame(spark, [(0, [2.0, 0.0]), (1, [-2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])])
    m = whitening.moments(rows)
    assert np.allclose(m.covariance, np.diag([2.0, 0.5]))
    one = np.array([[1.0, 1.0]])
    assert np.allclose(whitening.fit(m).rows(one), [[1.414214, 0.707107]], atol=1e-6)
    assert np.allclose(whitening.fit(m, mode="zca").rows(one), [[0.707107, 1.414214]], atol=1e-6)
    with pytest.raises(errors.InvalidArgument):
        whitening.fit(m, mode="other")


def test_versions_bridges_and_refits(spark):
    rows = cloud(spark, 100, 4, 1)
    w = whitening.Whitening()
    a = w.fit(rows)
    w.update(rows.where("doc_id < 50"))
    w.update(rows.where("doc_id >= 50"))
    b = w.finalize()
    assert np.allclose(w.get(a).matrix, w.get(b).matrix) and np.allclose(whitening.bridge(w.get(a), w.get(b)), np.eye(4))
    moved = w.get(a).apply(rows)
    assert np.allclose(w.get(w.refit(moved, a)).matrix, w.get(a).matrix)
    same = {r.doc_id: r.x for r in whitening.retarget(moved, w.get(a), w.get(b)).collect()}
    assert all(np.allclose(same[r.doc_id], r.x) for r in moved.collect())
    with pytest.raises(errors.NotFound):
        w.get(99)
    with pytest.raises(errors.FailedPrecondition):
        w.finalize()
    flat = whitening.moments(frame(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0])]))
    assert np.isfinite(whitening.fit(flat).matrix).all()
    with pytest.raises(errors.FailedPrecondition):
        whitening.fit(flat).inverse  # noqa: B018
    with pytest.raises(errors.FailedPrecondition):
        whitening.fit(flat, mode="zca")
    cosine = whitening.fit(whitening.moments(rows), cosine=True)
    assert np.allclose(np.linalg.norm(cosine.rows(np.ones((2, 4))), axis=1), 1) and np.allclose(cosine.rows(cosine.mean[None]), 0)


# --- changes -------------------------------------------------------------


def test_online_update_by_hand():
    model = ivf.IvfModel(np.zeros((1, 1)), np.array([[[0.0], [10.0]]]))
    x, lists = np.array([[1.0], [3.0], [8.0]]), np.zeros(3, np.int64)
    added = mutate.sums(x, lists, None, model, 0.0)
    assert added.n.tolist() == [[2, 1]] and added.nqe == pytest.approx(0.6875)
    state = mutate.OnlineState(np.array([[4, 1]]))
    z, n, drift = mutate.update_codebooks(model, state, added, None, mutate.OnlineConfig())
    assert np.allclose(z.ravel(), [0.666667, 9.0], atol=1e-6) and n.tolist() == [[6, 2]] and drift == pytest.approx(1.20185, abs=1e-5)
    gone = mutate.sums(np.array([[0.0]]), np.zeros(1, np.int64), None, model)
    z, n, _ = mutate.update_codebooks(model, state, added, gone, mutate.OnlineConfig())
    assert z[0, 0, 0] == pytest.approx(0.8) and n[0, 0] == 5
    z, _, _ = mutate.update_codebooks(model, state, added, None, mutate.OnlineConfig(top_lambda=0.5))
    assert np.allclose(z.ravel(), [0.666667, 10.0], atol=1e-6)


def test_error_tracking_and_gate():
    config = mutate.OnlineConfig(interval=2, ema_alpha=0.5, warmup_batches=2)
    s = mutate.OnlineState(np.zeros((1, 1)))
    seen = []
    for nqe in (1.0, 3.0, 4.0, 8.0):
        s = mutate.error_state(s, nqe, config)
        seen.append((s.baseline, s.ema, mutate.may_update(s, config)))
    assert seen == [(1.0, 1.0, False), (2.0, 2.0, False), (2.0, 3.0, False), (2.0, 5.5, True)] and s.ratio() == 2.75
    assert not mutate.may_update(s, mutate.OnlineConfig(interval=0)) and not mutate.may_update(s, config, skip_once=True)
    assert [mutate.top_fraction(r, 10) for r in (0.0, 0.11, 1.0)] == [1, 2, 10]


def test_adds_and_deletes_are_checked(spark, six):
    model = ivf.IvfModel(CENTRES)
    held = ivf.postings_of(ivf.encode(six, model))
    for rows, error in (([(0, [1.0, 1.0])], errors.AlreadyExists), ([(9, [1.0])], errors.InvalidArgument), ([(9, [1.0, 1.0])] * 2, errors.InvalidArgument)):
        with pytest.raises(error):
            mutate.add(held, frame(spark, rows), model)
    more = mutate.add(held, frame(spark, [(9, [6.0, 6.0])]), model)
    assert more.where("doc_id = 9").first().list_id == 1 and more.count() == 7
    for gone, error in (([(7,)], errors.NotFound), ([(1,), (1,)], errors.InvalidArgument)):
        with pytest.raises(error):
            mutate.delete(held, frame(spark, gone, "doc_id long"))
    assert mutate.delete(more, frame(spark, [(9,), (0,)], "doc_id long")).count() == 5


def test_sliding_window_and_optimistic_commits(spark):
    rows = durable(cloud(spark, 120, 4))
    model = ivf.train(rows.where("doc_id < 60"), 3, 2, 2, iterations=3)
    held = ivf.postings_of(ivf.encode(rows.where("doc_id < 60"), model), "active")
    counts = np.zeros((2, 4), np.int64)
    for r in ivf.code_counts(held, model).collect():
        counts[r["m"], r["k"]] = r["n"]
    handle = mutate.IndexHandle(held, model, mutate.OnlineState(counts))
    config = mutate.OnlineConfig(interval=1)
    expired = mutate.window_expired(held.select("doc_id", F.col("doc_id").alias("insert_seq")), 20, 50)
    assert sorted(r.doc_id for r in expired.collect()) == list(range(30))
    first = handle.prepare(rows.where("doc_id >= 60 and doc_id < 80"), config, expired=expired, vectors=rows)
    second = handle.prepare(rows.where("doc_id >= 80 and doc_id < 90"), config)
    report = handle.commit(first)
    assert report.updated and report.drift > 0 and report.deleted == 30 and handle.state.stale_codes
    assert handle.postings.count() == 50 and handle.state.counts.sum(axis=1).tolist() == [50, 50]
    with pytest.raises(errors.Unavailable):
        handle.commit(second)
    with pytest.raises(errors.FailedPrecondition):
        mutate.start_from(model, 2, initialised=True)
    assert mutate.start_from(model, 2)[0].version == 2


# --- merging -------------------------------------------------------------


def test_balanced_assignment_by_hand(spark):
    model = ivf.IvfModel(np.array([[0.0], [2.0]]))
    main = frame(spark, [("main", 0, 10 + i, None) for i in range(3)] + [("main", 1, 20, None)], POSTING)
    delta = frame(spark, [(0, [0.9]), (1, [1.0]), (2, [0.95])])
    config = merge.MergeConfig(top_r=2, gamma=1.5, hard_cap_ratio=1.5, lam=0.2)
    got = merge.assign_recent(delta, main, model, config)
    assert [r.list_id for r in got.rows.orderBy("doc_id").collect()] == [1, 1, 0]
    assert got.moved_ratio == pytest.approx(2 / 3) and got.avg_distance_ratio == pytest.approx(1.164609, abs=1e-5) and got.max_distance_ratio == pytest.approx(1.493827, abs=1e-5)
    assert (got.imbalance_before, round(got.imbalance_after, 6)) == (1.5, 1.142857)
    stats = {r.list_id: r for r in merge.partition_stats(got.rows, main).collect()}
    assert stats[0].growth == pytest.approx(1 / 3) and stats[0].avg_residual == pytest.approx(0.9025) and stats[1].growth == 2 and stats[1].avg_residual == pytest.approx(1.105)
    assert [r.list_id for r in merge.score_partitions(merge.partition_stats(got.rows, main), merge.MergeConfig(threshold=1.0)).where("recluster").collect()] == [1]


@pytest.mark.parametrize("mode", ["nearest", "balanced_append"])
def test_merging_keeps_every_row_and_fresh_codes(spark, mode):
    rows = durable(cloud(spark, 200, 4, 3))
    model = ivf.train(rows.where("doc_id < 120"), 6, 2, 3, iterations=4)
    main = durable(ivf.postings_of(ivf.encode(rows.where("doc_id < 120"), model)))
    recent = rows.where("doc_id >= 120").select("doc_id")
    out, report = merge.merge(main, recent, rows, model, merge.MergeConfig(mode=mode, gamma=1.5))
    assert routes.coverage_faults(out, 200).count() == 0 and report.rows == 80 and report.reused + report.encoded >= 80
    fresh = {r.doc_id: r.code for r in ivf.encode(rows, model, out.select("doc_id", "list_id")).collect()}
    assert all(fresh[r.doc_id] == r.code for r in out.collect())
    if mode == "nearest":
        want = {r.doc_id: r.list_id for r in ivf.assign(rows, model.centroids).collect()}
        assert {r.doc_id: r.list_id for r in out.collect()} == want
    scored = spark.createDataFrame([(i, i % 2 == 0) for i in range(6)], "list_id int, recluster boolean")
    order = merge.list_order(out, rows, scored, model).collect()
    assert sorted(r.doc_id for r in order) == list(range(200))


def test_patches_are_checked(spark):
    main = frame(spark, [("main", i % 2, i, None) for i in range(4)], POSTING)
    good = frame(spark, [("main", 0, 0, None), ("main", 0, 2, None), ("main", 0, 9, None)], POSTING)
    assert sorted(r.doc_id for r in merge.commit_patch(main, good, [0], 1, 1).collect()) == [0, 1, 2, 3, 9]
    for rows, gen, error in (([("main", 1, 5, None)], 1, errors.InvalidArgument), ([("main", 0, 5, None)] * 2, 1, errors.InvalidArgument), ([("main", 0, 1, None)], 1, errors.AlreadyExists), ([], 0, errors.Unavailable)):
        with pytest.raises(error):
            merge.commit_patch(main, frame(spark, rows, POSTING), [0], gen, 1)


def test_neighbourhoods():
    centres = np.array([[0.0], [1.0], [2.0], [10.0], [11.0]])
    assert merge.plan_neighbourhoods(centres, {0: 5, 1: 9, 4: 1}, 3) == {1: 0, 0: 0, 2: 0, 4: 1, 3: 1}
    assert merge.plan_neighbourhoods(centres, {}, 3) == {}


def test_triggers():
    t = triggers.MergeTrigger("hybrid", rows=100, train_rows=10, qe_ratio=1.2, imbalance=3, delta_main_ratio=0.5)
    assert t.decide(99, 1000, 1.1) == triggers.Decision(False, "none")
    assert t.decide(100, 150, 1.2, imbalance=4) == triggers.Decision(True, "delta_full+structure_imbalance+delta_main_ratio+qe_ratio")
    assert triggers.MergeTrigger("qe_ratio", train_rows=1, qe_ratio=2).decide(5, 0, 3).reason == "delta_full+qe_ratio"
    assert not triggers.MergeTrigger("drift", train_rows=1, drift=2).decide(5, 0, 3).fires
    assert triggers.MergeTrigger(train_rows=1, enable=False).decide(5, 0).reason == "merge_disabled"
    with pytest.raises(errors.InvalidArgument):
        triggers.MergeTrigger("sometimes")
    r = triggers.RebuildTrigger(True, 2, 3.0, 100, 50)
    assert r.decide(100, 4, 0, 500).reason == "main_rows+main_structure_imbalance" and r.decide(0, 1, 0, 500).reason == "none"
    assert r.decide(100, 4, 2, 500).reason == "max_count_reached" and r.decide(100, 4, 1, 500, 470).reason == "cooldown"
    assert triggers.RebuildTrigger().decide(9, 9, 0, 9) == triggers.Decision(False, "none")


# --- sources -------------------------------------------------------------


def test_vector_files(spark, tmp_path, six):
    path = str(tmp_path / "a_base.fvecs")
    info = fvecs.write(six, path)
    assert (info.rows, info.dim) == (6, 2) == (fvecs.inspect(spark, path).rows, fvecs.inspect(spark, path).dim)
    assert sorted(fvecs.read(spark, path).collect()) == sorted(six.collect())
    assert sorted(r.doc_id for r in fvecs.read(spark, path, 2, 3).collect()) == [2, 3, 4] and fvecs.read(spark, path, 6, 0).count() == 0
    assert fvecs.resolve(spark, str(tmp_path), "_base.fvecs").endswith("a_base.fvecs") and fvecs.resolve(spark, path, "x") == path
    with pytest.raises(errors.InvalidArgument):
        fvecs.read(spark, path, 5, 2)
    for name, data in (("empty", b""), ("dim", struct.pack("<i", 0)), ("cut", struct.pack("<iff", 2, 1, 1) + b"x")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(errors.DataCorruption):
            fvecs.inspect(spark, str(tmp_path / name))
    (tmp_path / "mixed").write_bytes(struct.pack("<iff", 2, 1, 1) + struct.pack("<iff", 3, 1, 1))
    with pytest.raises(Exception, match="another dimension"):
        fvecs.read(spark, str(tmp_path / "mixed")).count()
    for f in (lambda: fvecs.inspect(spark, str(tmp_path / "none")), lambda: fvecs.resolve(spark, str(tmp_path), ".zzz")):
        with pytest.raises(errors.NotFound):
            f()
    a, b = (sorted(fvecs.synthetic(spark, 20, 3, s).collect()) for s in (1, 2))
    assert a != b and a == sorted(fvecs.synthetic(spark, 20, 3, 1).repartition(3).collect()) and all(-1 <= v < 1 for r in a for v in r.x)


def test_settings(spark, tmp_path):
    assert len(options.asdict(options.Settings())) == 81
    (tmp_path / "s.json").write_text(json.dumps({"topk": 5, "merge_assignment_mode": "local_constrained", "nprobe_sweep": [1, 2], "online_pq_alpha": 1}))
    s = options.load(spark, str(tmp_path / "s.json"))
    assert (s.topk, s.merge_assignment_mode, s.nprobe_sweep, s.online_pq_alpha) == (5, "balanced_append", (1, 2), 1.0)
    bad = [
        {"nope": 1}, {"topk": "5"}, {"topk": -1}, {"use_cosine": 1}, {"nprobe_sweep": [0]}, {"nprobe_sweep": [-1]}, {"streaming_mode": "x"}, {"stream_batch_size": 0}, {"concurrent_gt_mode": "x"}, {"concurrent_init_mode": "x"}, {"concurrent_init_mode": "load"},
        {"concurrent_target_insert_vecps": -1}, {"concurrent_workload_enable": True, "concurrent_query_workers": 0}, {"exact_rerank_enable": True}, {"exact_rerank_enable": True, "exact_rerank_candidates_per_route": 9}, {"enable_rerank_source_diag": True},
        {"enable_streaming": True, "delta_train_window": 0}, {"merge_score_alpha": -1.0}, {"merge_score_beta": -1}, {"merge_score_threshold": -1}, {"merge_trigger_mode": "x"}, {"merge_trigger_qe_ratio": -1}, {"merge_trigger_drift": -1}, {"merge_trigger_delta_main_ratio": -1},
        {"merge_trigger_imbalance_ratio": -1}, {"merge_assignment_mode": "x"}, {"merge_assignment_top_r": 0}, {"merge_assignment_gamma": 0}, {"merge_assignment_hard_cap_ratio": 0}, {"merge_assignment_lambda": -1}, {"global_rebuild_main_imbalance_ratio": -1},
        {"merge_trigger_mode": "qe_ratio"}, {"merge_trigger_mode": "drift"}, {"merge_trigger_mode": "imbalance"}, {"merge_trigger_mode": "delta_main_ratio"}, {"merge_trigger_mode": "state"}, {"merge_trigger_mode": "hybrid"}, {"enable_global_rebuild": True},
        {"enable_global_rebuild": True, "global_rebuild_max_count": 1}, {"online_pq_update_scheme": "x"}, {"online_pq_update_scheme": "sliding_window"}, {"online_pq_update_scheme": "sliding_window", "online_pq_sliding_window_size": 1}, {"online_pq_ema_alpha": 0},
        {"online_pq_ema_alpha": 1.1}, {"online_pq_eps": 0}, {"online_pq_warmup_enable": True}, {"online_pq_alpha": 2}, {"online_pq_lambda": 0}, {"final_state_cache_mode": "x"}, {"final_state_cache_mode": "save"}, {"final_state_cache_mode": "load", "final_state_cache_path": "p"},
        {"final_state_cache_mode": "prepare", "final_state_cache_path": "p", "nprobe_sweep": [1]},
    ]
    for raw in bad:
        with pytest.raises(errors.InvalidArgument):
            options.parse(json.dumps(raw))
    for text in ("{", "[]"):
        with pytest.raises(errors.InvalidArgument):
            options.parse(text)


def test_workloads(spark, tmp_path):
    ops = {"dataset": "demo", "operations": [{"op_id": 5, "operation": "insert", "start": 0, "end": 4, "round": 2, "cluster": None}, {"op": "search"}, {"op": "insert", "start": 4}]}
    (tmp_path / "w.json").write_text(json.dumps(ops))
    got = [tuple(r)[1:8] for r in workload.check(workload.read(spark, str(tmp_path / "w.json"))).orderBy("place").collect()]
    assert got == [(5, "insert", 0, 4, 4, 2, -1), (1, "search", 0, 0, 0, -1, -1), (2, "insert", 4, 4, 4, -1, -1)]
    (tmp_path / "b.json").write_text(json.dumps({"operations": [{"op": "drop"}]}))
    with pytest.raises(errors.InvalidArgument):
        workload.check(workload.read(spark, str(tmp_path / "b.json")))


@settings(max_examples=100)
@given(st.integers(0, 20), st.integers(0, 20), st.integers(0, 20))
def test_insert_ranges(start, end, seen):
    if end <= seen:
        assert workload.insert_range(start, end, seen) is None
    elif start > seen:
        with pytest.raises(errors.InvalidArgument):
            workload.insert_range(start, end, seen)
    else:
        assert workload.insert_range(start, end, seen) == (max(start, seen), end)


def test_artifacts(spark, tmp_path):
    rows = cloud(spark, 60, 4)
    model = ivf.train(rows, 3, 2, 2, iterations=2)
    held = durable(ivf.postings_of(ivf.encode(rows, model)))
    p = str(tmp_path)
    state = mutate.OnlineState(np.arange(8).reshape(2, 4), 3, baseline=0.5)
    artifacts.save_index(f"{p}/i", model, held, state)
    m, h, s = artifacts.load_index(spark, f"{p}/i")
    assert np.array_equal(m.centroids, model.centroids) and np.array_equal(m.codebooks, model.codebooks) and sorted(h.collect()) == sorted(held.collect()) and np.array_equal(s.counts, state.counts) and s.batch_no == 3
    w = whitening.Whitening()
    w.fit(rows)
    artifacts.save_prebuilt(f"{p}/p", model, held, w, 60, 60)
    assert np.allclose(artifacts.load_prebuilt(spark, f"{p}/p", dim=4, main_rows=60)[2].get(0).matrix, w.get(0).matrix)
    with pytest.raises(errors.FailedPrecondition):
        artifacts.load_prebuilt(spark, f"{p}/p", dim=5)
    with pytest.raises(errors.DataCorruption):
        artifacts.load_index(spark, f"{p}/p")
    with pytest.raises(errors.NotFound):
        artifacts.load_index(spark, f"{p}/nothing")
    truth = spark.createDataFrame([(10, 0, 1, 7)], "frontier int, query_id long, rank int, doc_id long")
    artifacts.save_truth(f"{p}/t", truth, 1, 1, 5, 5)
    assert artifacts.load_truth(spark, f"{p}/t", k=1).collect() == truth.collect()
    with pytest.raises(errors.FailedPrecondition):
        artifacts.load_truth(spark, f"{p}/t", k=2)
    artifacts.save_final_state(f"{p}/f", model, held, truth, 60, rows)
    assert artifacts.load_final_state(spark, f"{p}/f", rows=60)[3].count() == 60
    with pytest.raises(errors.FailedPrecondition):
        artifacts.save_final_state(f"{p}/g", model, held, truth, 61)
    artifacts.save_blob(spark, f"{p}/b", b"\x00\xff")
    assert artifacts.load_blob(spark, f"{p}/b") == b"\x00\xff"
    artifacts.write_report(spark, f"{p}/r", {"k": 1}, {"recall": 1.0}, [], [{"seen": 1}])
    assert json.loads(spark.read.text(f"{p}/r").first()[0])["metrics"]["recall"] == 1.0
    artifacts.write_csv(truth, f"{p}/c", "rank")
    artifacts.write_curve(spark.createDataFrame([(1, 0.5, 0.1)], "nprobe int, recall double, seconds double"), f"{p}/n")
    assert spark.read.csv(f"{p}/c", header=True).count() == 1 and spark.read.json(f"{p}/n").count() == 1
    assert {r.structure: r.bytes for r in artifacts.memory_trace(held, model).collect()}["postings"] == 60 * 14


# --- runs ----------------------------------------------------------------


def test_stream_with_sliding_window_rebuild_and_sweep(spark):
    rows = durable(cloud(spark, 200, 8, 5))
    q = rows.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    s = harness.demo_settings(200, pq_m=4, pq_nbits=3, snapshot_interval=40, enable_global_rebuild=True, global_rebuild_max_count=1, global_rebuild_force_main_rows=20, max_queries=3, nprobe_sweep=[1, 8])
    e = harness.Engine(spark, rows, q, s).run()
    kinds = [x["kind"] for x in e.events]
    assert "freeze" in kinds and "merge" in kinds and "rebuild" in kinds and e.rebuilds == 1
    held = [x.postings for x in e.shards()]
    every = held[0]
    for h in held[1:]:
        every = every.unionByName(h)
    assert routes.coverage_faults(every, 200).count() == 0 and e.snapshots[-1]["seen"] == 200 and e.q.count() == 3
    curve = {r.nprobe: r.recall for r in e.sweep().collect()}
    assert curve[8] >= curve[1] and curve[8] >= 0.9


def test_window_of_a_stream(spark):
    rows = durable(cloud(spark, 150, 8, 6))
    s = harness.demo_settings(150, pq_m=4, pq_nbits=3, merge_trigger_rows=1000, online_pq_update_scheme="sliding_window", online_pq_sliding_window_size=2)
    e = harness.Engine(spark, rows, rows.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q")), s).run()
    assert sorted(r.doc_id for r in e.active.postings.collect()) == list(range(120, 150)) and e.active.rows == 30


def test_replay_warms_up_and_refuses_gaps(spark):
    rows = durable(cloud(spark, 100, 8, 7))
    q = rows.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    s = harness.demo_settings(100, pq_m=4, pq_nbits=3)
    ops = [{"op_id": 0, "operation": "search"}, {"op_id": 1, "operation": "insert", "start": 0, "end": 60}, {"op_id": 2, "operation": "insert", "start": 10, "end": 50}, {"op_id": 3, "operation": "search"}]
    e = harness.Engine(spark, rows, q, s).replay(ops, 50)
    assert e.events[0]["kind"] == "warm_up" and len(e.snapshots) == 1 and e.seen == 60
    with pytest.raises(errors.InvalidArgument):
        e.replay([{"op_id": 4, "operation": "insert", "start": 70, "end": 80}], 50)


def test_replayed_micro_batches_publish_once(spark, tmp_path, six):
    model = ivf.IvfModel(CENTRES)
    for batch_id in (0, 1, 1):
        ingest.publish_batch(six.where(f"doc_id div 3 = {batch_id}"), batch_id, model, str(tmp_path), "active")
    assert routes.coverage_faults(ingest.published(spark, str(tmp_path)), 6).count() == 0


def test_windowed_latencies_of_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp '2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, cast(id AS double) AS value FROM range(9)").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/e")
    q = ingest.latency_stream(stream).writeStream.format("memory").queryName("lat").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted((r.n, r.max) for r in spark.sql("SELECT n, max FROM lat").collect()) == [(3, 2.0), (3, 5.0), (3, 8.0)]
