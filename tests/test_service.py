"""Concurrent service, command line, saved starts, introspection, and plans."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillvec import __main__ as cli
from rillvec import catalog, errors
from rillvec.operators import exact, ivf, metrics, whitening
from rillvec.plans import concurrent, durable, harness
from rillvec.sources import artifacts, fvecs

SF = "/root/testdata/sf0.001"


def cloud(spark, n, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<float>")


def test_service_recall_by_seen_version(spark):
    rows = durable.durable(cloud(spark, 200))
    q = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))
    s = harness.demo_settings(200, pq_m=8, pq_nbits=4, concurrent_workload_enable=True, concurrent_query_workers=2, concurrent_target_insert_vecps=10_000.0)
    service = concurrent.Service(harness.Engine(spark, rows, q, s)).run(200)
    assert service.batch_table().agg(F.max("end_row")).first()[0] == 200 and service.record_table().count() == 4 * 5
    truth = service.truth()
    assert truth.where("frontier < 200 and doc_id >= frontier").count() == 0
    last = service.recall("completed", truth).where(F.col("version") == len(service.batches))
    assert last.count() >= 4 and last.agg(F.min("recall")).first()[0] >= 0.9
    assert all(r.version <= r.completed for r in service.record_table().collect())
    lag = metrics.insert_lag(service.batch_table(), 10_000.0).collect()
    assert len(lag) == len(service.batches) and all(r.lag_ms >= 0 for r in lag)
    assert {r.lag_ms for r in metrics.insert_lag(service.batch_table(), 0).collect()} == {0.0}


def test_command_line(spark, tmp_path):
    rows = cloud(spark, 120)
    fvecs.write(rows, str(tmp_path / "d_base.fvecs"))
    fvecs.write(rows.where("doc_id < 4"), str(tmp_path / "d_query.fvecs"))
    options = {k: v for k, v in vars(harness.demo_settings(120, pq_m=4, pq_nbits=3, nprobe_sweep=(2, 8))).items() if k != "dim"}
    (tmp_path / "s.json").write_text(json.dumps(options))
    (tmp_path / "d_workload.json").write_text(json.dumps({"operations": [{"op": "insert", "start": 0, "end": 120}, {"op": "search"}]}))
    s, d = str(tmp_path / "s.json"), str(tmp_path)
    cli.main(["build", s, d, f"{d}/built"], spark)
    e = cli.main(["stream", s, d, d, f"{d}/r1", "--prebuilt", f"{d}/built"], spark)
    assert e.seen == 120 and e.snapshots[-1]["kind"] == "final"
    report = json.loads(spark.read.text(f"{d}/r1/summary").first()[0])
    assert report["metrics"]["rows"] == 120 and spark.read.json(f"{d}/r1/curve").count() == 2
    assert cli.main(["replay", s, d, d, d, f"{d}/r2", "--bootstrap", "60"], spark).snapshots
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_saved_starts_and_introspection(spark, tmp_path):
    rows = cloud(spark, 40, 4)
    pq, flat = ivf.train(rows, 3, 2, 2, iterations=2), ivf.train(rows, 3, iterations=2)
    held, plain = (durable.durable(ivf.postings_of(ivf.encode(rows, m))) for m in (pq, flat))
    w = whitening.Whitening()
    w.fit(rows)
    artifacts.save_init(f"{tmp_path}/i", (pq, held), w, (flat, plain), main_rows=40)
    main, space, active = artifacts.load_init(spark, f"{tmp_path}/i", main_rows=40)
    assert np.array_equal(main[0].codebooks, pq.codebooks) and active[1].count() == 40 and not active[0].is_pq and 0 in space.versions
    assert ivf.code_of(held, 7).count() == 1 and sorted(r.doc_id for r in ivf.doc_ids(held).collect()) == list(range(40))
    assert ivf.records(plain, rows, flat).count() == 40 and ivf.records(plain, rows, flat, 0).count() == plain.where("list_id = 0").count()
    with pytest.raises(errors.FailedPrecondition):
        ivf.records(held, rows, pq)
    events = spark.createDataFrame([(5, 0, True, 0.1, 1.0, 0.5), (7, 2, False, 0.3, 1.2, 0.0)], "rows int, deleted int, updated boolean, nqe double, ratio double, drift double")
    c = metrics.counters(events).first()
    assert (c.batches, c.rows, c.deleted, c.updates, c.drift_max) == (2, 12, 2, 1, 0.5)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    rows, q = catalog.base(spark, SF), catalog.query_rows(spark, SF)
    p = plan_of(exact.exact_topk(rows, q, 10))
    assert "MapInArrow" in p and "NestedLoop" not in p and "Cartesian" not in p and "WindowGroupLimit" in p
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    p = plan_of(ivf.encode(rows, catalog.pq_model(spark, SF)))
    assert "Exchange" not in p
    p = plan_of(exact.exact_topk(rows, q, 10, seen_rows=100))
    assert "LessThan(vec_id,100)" in p
    table = durable.durable(rows)
    assert table.count() == 500 and durable.release(spark) >= 1


def test_executors_need_not_import_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from rillvec import catalog
print("rows", catalog.QUERIES["adc_search"](spark, {SF!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=240)
    assert "rows 50" in out.stdout, out.stderr[-2000:]


def test_modes_save_and_load_states(spark, tmp_path):
    """A stream's end, a service's start and its truth: written by one run, read by the next."""
    rows = cloud(spark, 60, 4)
    d = str(tmp_path)
    fvecs.write(rows, f"{d}/d_base.fvecs")
    fvecs.write(rows.where("doc_id < 4"), f"{d}/d_query.fvecs")
    plain = {k: v for k, v in vars(harness.demo_settings(60, pq_enable=False, pq_m=0, merge_trigger_rows=1000, ivf_nlist=3, delta_ivf_nlist=2, dim=4)).items()}

    def settings_file(name, **changes):
        (tmp_path / name).write_text(json.dumps(plain | changes))
        return f"{d}/{name}"

    saved = cli.main(["stream", settings_file("s1", final_state_cache_mode="save", final_state_cache_path=f"{d}/end"), d, d, f"{d}/r1"], spark)
    load = settings_file("s2", final_state_cache_mode="load", final_state_cache_path=f"{d}/end", nprobe_sweep=[1, 8])
    loaded = cli.main(["stream", load, d, d, f"{d}/r2"], spark)
    order = ["query_id", "rank"]
    assert loaded.search().select("query_id", "rank", "doc_id").orderBy(*order).collect() == saved.search().select("query_id", "rank", "doc_id").orderBy(*order).collect()
    assert loaded.active is not None and loaded.active.rows == saved.active.rows and not loaded.snapshots
    assert spark.read.json(f"{d}/r2/curve").orderBy("nprobe").collect()[-1].recall == 1.0
    with pytest.raises(errors.FailedPrecondition):
        cli.main(["stream", settings_file("s3", final_state_cache_mode="load", final_state_cache_path=f"{d}/end", nprobe_sweep=[1], topk=9), d, d, f"{d}/r3"], spark)

    paths = {"concurrent_init_path": f"{d}/init", "concurrent_gt_path": f"{d}/truth", "concurrent_workload_enable": True}
    first = cli.main(["serve", settings_file("s4", concurrent_init_mode="prepare", concurrent_gt_mode="prepare", **paths), d, d, f"{d}/r4"], spark)
    second = cli.main(["serve", settings_file("s5", concurrent_init_mode="load", concurrent_gt_mode="load", **paths), d, d, f"{d}/r5"], spark)
    assert np.array_equal(first.main.model.centroids, second.main.model.centroids) and second.seen == 60
    recall = [spark.read.option("header", True).option("inferSchema", True).csv(f"{d}/{r}/recall-version").agg(F.min("recall")).first()[0] for r in ("r4", "r5")]
    assert min(recall) >= 0.9
    with pytest.raises(errors.FailedPrecondition):
        cli.main(["serve", settings_file("s6", concurrent_init_mode="load", concurrent_gt_mode="load", **(paths | {"stream_batch_size": 9})), d, d, f"{d}/r6"], spark)
