"""Saved indexes, transforms, ground truths and terminal states: folders of Parquet with a manifest."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataCorruption, FailedPrecondition, NotFound
from ..operators.ivf import IvfModel
from ..operators.mutate import OnlineState
from ..operators.routes import coverage_faults
from ..operators.whitening import Whitening

FORMAT = 1


def _manifest(spark: SparkSession, path: str, kind: str, **facts) -> None:
    spark.createDataFrame([(json.dumps({"kind": kind, "format": FORMAT, **facts}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, kind: str) -> dict:
    try:
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect())
    except Exception as e:
        raise NotFound(f"no manifest in {path}") from e
    facts = json.loads(text)
    if facts.get("kind") != kind or facts.get("format") != FORMAT:
        raise DataCorruption(f"{path} holds {facts.get('kind')} of format {facts.get('format')}")
    return facts


def require(facts: dict, **expected) -> None:
    """Metadata must be what the run needs."""
    for name, value in expected.items():
        if facts.get(name) != value:
            raise FailedPrecondition(f"{name} is {facts.get(name)}, needed is {value}")


def save_blob(spark: SparkSession, path: str, data: bytes) -> None:
    spark.createDataFrame([(bytearray(data),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_blob(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(path).first()["content"])


def save_index(path: str, model: IvfModel, postings: DataFrame, state: OnlineState | None = None) -> None:
    """Centroids, codebooks, state, and postings partitioned by shard and clustered by list."""
    spark = postings.sparkSession
    model.centroid_table(spark).write.mode("overwrite").parquet(f"{path}/centroids")
    if model.is_pq:
        model.codebook_table(spark).write.mode("overwrite").parquet(f"{path}/codebooks")
    postings.repartition("list_id").sortWithinPartitions("list_id", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    facts = {} if state is None else {"batch_no": state.batch_no, "baseline": state.baseline, "ema": state.ema, "generation": state.generation, "warmup_sum": state.warmup_sum, "warmup_seen": state.warmup_seen, "stale_codes": state.stale_codes, "counts": state.counts.tolist()}
    _manifest(spark, path, "index", version=model.version, nlist=model.nlist, dim=model.dim, residual=model.residual, m=0 if model.codebooks is None else len(model.codebooks), rows=postings.count(), state=facts)


def load_index(spark: SparkSession, path: str) -> tuple[IvfModel, DataFrame, OnlineState | None]:
    facts = manifest(spark, path, "index")
    centres = np.array([r["c"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()])
    books = None
    if facts["m"]:
        rows = spark.read.parquet(f"{path}/codebooks").orderBy("m", "k").collect()
        books = np.array([r["z"] for r in rows]).reshape(facts["m"], -1, facts["dim"] // facts["m"])
    s = facts["state"]
    state = OnlineState(np.array(s["counts"]), s["batch_no"], s["warmup_sum"], s["warmup_seen"], s["baseline"], s["ema"], s["generation"], s["stale_codes"]) if s else None
    postings = spark.read.schema("list_id int, doc_id long, code array<short>, shard string").parquet(f"{path}/postings").select("shard", "list_id", "doc_id", "code")
    return IvfModel(centres, books, facts["residual"], facts["version"]), postings, state


def save_whitening(spark: SparkSession, path: str, whitening: Whitening) -> None:
    whitening.table(spark).write.mode("overwrite").parquet(f"{path}/versions")
    _manifest(spark, path, "whitening", mode=whitening.mode, versions=sorted(whitening.versions))


def load_whitening(spark: SparkSession, path: str) -> Whitening:
    facts = manifest(spark, path, "whitening")
    return Whitening.from_table(spark.read.parquet(f"{path}/versions"), facts["mode"])


def save_prebuilt(path: str, model: IvfModel, postings: DataFrame, whitening: Whitening | None, main_rows: int, total_rows: int) -> None:
    """A consolidated index that runs may start from."""
    spark = postings.sparkSession
    save_index(f"{path}/index", model, postings)
    if whitening is not None:
        save_whitening(spark, f"{path}/whitening", whitening)
    _manifest(spark, path, "prebuilt", dim=model.dim, main_rows=main_rows, total_rows=total_rows, whitening=whitening is not None)


def load_prebuilt(spark: SparkSession, path: str, **expected) -> tuple[IvfModel, DataFrame, Whitening | None]:
    facts = manifest(spark, path, "prebuilt")
    require(facts, **expected)
    model, postings, _ = load_index(spark, f"{path}/index")
    return model, postings, load_whitening(spark, f"{path}/whitening") if facts["whitening"] else None


def save_init(path: str, main: tuple[IvfModel, DataFrame], whitening: Whitening | None = None, active: tuple[IvfModel, DataFrame] | None = None, **facts) -> None:
    """Where a concurrent run starts: transform, consolidated index, and an active one if there is any."""
    spark = main[1].sparkSession
    save_index(f"{path}/main", *main)
    if whitening is not None:
        save_whitening(spark, f"{path}/whitening", whitening)
    if active is not None:
        save_index(f"{path}/active", *active)
    _manifest(spark, path, "init", dim=main[0].dim, whitening=whitening is not None, active=active is not None, **facts)


def load_init(spark: SparkSession, path: str, **expected) -> tuple[tuple[IvfModel, DataFrame], Whitening | None, tuple[IvfModel, DataFrame] | None]:
    facts = manifest(spark, path, "init")
    require(facts, **expected)
    active = load_index(spark, f"{path}/active")[:2] if facts["active"] else None
    return load_index(spark, f"{path}/main")[:2], load_whitening(spark, f"{path}/whitening") if facts["whitening"] else None, active


def save_truth(path: str, truth: DataFrame, queries: int, k: int, initial: int, batch: int) -> None:
    """Ground truth (frontier, query_id, rank, doc_id) of a stream's frontiers."""
    truth.select("frontier", "query_id", "rank", "doc_id").write.mode("overwrite").parquet(f"{path}/truth")
    _manifest(truth.sparkSession, path, "truth", queries=queries, k=k, initial=initial, batch=batch)


def load_truth(spark: SparkSession, path: str, **expected) -> DataFrame:
    require(manifest(spark, path, "truth"), **expected)
    return spark.read.parquet(f"{path}/truth")


def _check_coverage(parts: list[DataFrame], rows: int, live_only: bool, error: type[Exception]) -> None:
    every = parts[0].select("doc_id")
    for p in parts[1:]:
        every = every.unionAll(p.select("doc_id"))
    faults = coverage_faults(every, rows)
    if (faults.where("n > 1") if live_only else faults).limit(1).count():
        raise error("ids are not covered exactly once")


def save_final_state(path: str, model: IvfModel, postings: DataFrame, truth: DataFrame, rows: int, vectors: DataFrame | None = None, recent: dict[str, tuple[IvfModel, DataFrame]] | None = None, whitening: Whitening | None = None, live_only: bool = False, **facts) -> None:
    """The end of a run: every id below ``rows`` must be in exactly one shard, or with ``live_only`` (rows were deleted) in one at most.

    ``recent`` has the other shards by name, ``whitening`` the space of all.
    """
    recent = recent or {}
    _check_coverage([postings, *[p for _, p in recent.values()]], rows, live_only, FailedPrecondition)
    spark = postings.sparkSession
    save_index(f"{path}/index", model, postings)
    for name, part in recent.items():
        save_index(f"{path}/recent/{name}", *part)
    if whitening is not None:
        save_whitening(spark, f"{path}/whitening", whitening)
    truth.write.mode("overwrite").parquet(f"{path}/truth")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    _manifest(spark, path, "final_state", rows=rows, dim=model.dim, vectors=vectors is not None, recent=sorted(recent), whitening=whitening is not None, live_only=live_only, **facts)


def load_final_state(spark: SparkSession, path: str, **expected) -> tuple[IvfModel, DataFrame, DataFrame, DataFrame | None]:
    facts = manifest(spark, path, "final_state")
    require(facts, **expected)
    model, postings, _ = load_index(spark, f"{path}/index")
    _check_coverage([postings, *[p for _, p in load_recent(spark, path).values()]], facts["rows"], facts["live_only"], DataCorruption)
    return model, postings, spark.read.parquet(f"{path}/truth"), spark.read.parquet(f"{path}/vectors") if facts["vectors"] else None


def load_recent(spark: SparkSession, path: str) -> dict[str, tuple[IvfModel, DataFrame]]:
    """The shards of a saved final state beside the consolidated one."""
    return {name: load_index(spark, f"{path}/recent/{name}")[:2] for name in manifest(spark, path, "final_state")["recent"]}


# --- reports -------------------------------------------------------------


def write_report(spark: SparkSession, path: str, params: dict, metrics: dict, events: list[dict], snapshots: list[dict]) -> None:
    """One JSON document of a run."""
    text = json.dumps({"params": params, "metrics": metrics, "events": events, "snapshots": snapshots}, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """A time series, an insert log or an event log as CSV, in order."""
    df.orderBy(order).write.mode("overwrite").option("header", True).csv(path)


def write_curve(df: DataFrame, path: str) -> None:
    """nprobe, recall, seconds as JSON lines."""
    df.select("nprobe", "recall", "seconds").orderBy("nprobe").coalesce(1).write.mode("overwrite").json(path)


def memory_trace(postings: DataFrame, model: IvfModel) -> DataFrame:
    """structure, bytes."""
    from ..operators.metrics import memory_estimate

    m, words = (0, 0) if model.codebooks is None else model.codebooks.shape[:2]
    return memory_estimate(postings, model.dim, m, model.nlist, words).where(F.col("bytes") >= 0)
