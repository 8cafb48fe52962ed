"""Command line: build an index, run a stream, replay a workload, or serve while inserting.

    python -m rillvec build SETTINGS BASE OUT
    python -m rillvec stream SETTINGS BASE QUERIES REPORT [--prebuilt DIR]
    python -m rillvec replay SETTINGS BASE QUERIES WORKLOAD REPORT --bootstrap ROWS
    python -m rillvec serve SETTINGS BASE QUERIES REPORT [--rows N]

BASE and QUERIES are vector files, or folders that hold one (``*_base.fvecs``,
``*_query.fvecs``).  ``stream`` saves and loads final states, ``serve`` starts and truths, as the
settings' modes say.
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from .plans.concurrent import Service
from .plans.durable import durable
from .plans.harness import Engine
from .sources import artifacts, fvecs, settings, workload


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillvec", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("build", ("out",)), ("stream", ("queries", "report")), ("replay", ("queries", "workload", "report")), ("serve", ("queries", "report"))):
        c = sub.add_parser(name)
        for place in ("settings", "base", *places):
            c.add_argument(place)
        if name == "replay":
            c.add_argument("--bootstrap", type=int, required=True)
        if name == "stream":
            c.add_argument("--prebuilt")
        if name == "serve":
            c.add_argument("--rows", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Engine | None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rillvec").getOrCreate()
    s = settings.load(spark, a.settings)
    for name in settings.without_effect(s):
        print(f"{name} has no effect here")
    path = fvecs.resolve(spark, a.base, "_base.fvecs")
    info = fvecs.inspect(spark, path)
    if info.dim != s.dim:
        print(f"dim {info.dim} of {path} replaces {s.dim} of the settings")
        s = replace(s, dim=info.dim)
    base = durable(fvecs.read(spark, path), "base")
    if a.command == "build":
        e = Engine(spark, base, base.where("1 = 0").selectExpr("doc_id AS query_id", "x AS q"), s)
        rows = s.main_rows(info.rows)
        e.bootstrap(rows)
        artifacts.save_prebuilt(a.out, e.main.model, e.main.postings, e.whitening if s.use_whitening else None, rows, info.rows)
        return e
    queries = durable(fvecs.read(spark, fvecs.resolve(spark, a.queries, "_query.fvecs"), id_name="query_id", x_name="q"), "asked")
    e = Engine(spark, base, queries, s)
    if a.command == "stream":
        if a.prebuilt:
            e.adopt(*artifacts.load_prebuilt(spark, a.prebuilt, dim=s.dim, main_rows=s.main_rows(info.rows), total_rows=info.rows, whitening=s.use_whitening))
        if s.final_state_cache_mode == "load":
            e.load_final(s.final_state_cache_path)
        else:
            e.run(info.rows)
        if s.final_state_cache_mode in ("save", "prepare"):
            e.save_final(s.final_state_cache_path)
    elif a.command == "replay":
        ops = workload.check(workload.read(spark, fvecs.resolve(spark, a.workload, "_workload.json"))).orderBy("place")
        e.replay([r.asDict() for r in ops.toLocalIterator()], a.bootstrap)
    else:
        service = Service(e).run(a.rows or info.rows)
        artifacts.write_csv(service.record_table().drop("doc_ids"), f"{a.report}/queries", "completion_ms")
        artifacts.write_csv(service.batch_table(), f"{a.report}/inserts", "batch")
        if (s.enable_dynamic_ground_truth and not s.skip_query_ground_truth) or s.concurrent_gt_mode != "off":
            truth = service.truth()
            for at in ("version", "completed"):
                artifacts.write_csv(service.recall(at, truth), f"{a.report}/recall-{at}", "query_id")
    artifacts.write_report(spark, f"{a.report}/summary", asdict(s), {"rows": e.seen, "events": len(e.events), "backpressure": e.backpressure}, e.events, e.snapshots)
    if s.nprobe_sweep:
        artifacts.write_curve(e.sweep(), f"{a.report}/curve")
    return e


if __name__ == "__main__":
    main()
