"""Merging recent rows into the consolidated index.

Distances of recent rows to their nearest lists are computed in parallel; the
greedy rule that balances list sizes depends on the order of rows and runs as
one task over a stream of (row, candidate lists), of which there are top_r a
row; vectors and results stay on executors.  Neighbourhoods of lists are
repartitioned in parallel, each in order.  A merge is prepared against one
generation of the index and committed as a whole, or refused if the index has
moved on since.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AlreadyExists, InvalidArgument, Unavailable
from ..functions.vectors import l2sq
from ..plans.durable import durable
from ..plans.shared import share
from .exact import fast_sqdist, matrix
from .ivf import IvfModel, assign, encode, partition_sizes, postings_of


@dataclass(frozen=True)
class MergeConfig:
    mode: str = "balanced_append"
    top_r: int = 4
    gamma: float = 1.05
    hard_cap_ratio: float = 1.5
    lam: float = 0.2
    alpha: float = 1.0
    beta: float = 1e-7
    threshold: float = 10.0

    def __post_init__(self) -> None:
        if self.mode not in ("balanced_append", "nearest"):
            raise InvalidArgument("mode must be balanced_append or nearest")
        if self.top_r < 1 or self.gamma <= 0 or self.hard_cap_ratio <= 0 or self.lam < 0:
            raise InvalidArgument("top_r must be 1 or more, gamma and hard_cap_ratio above 0, lam 0 or more")


def _near_lists(shared, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            d = fast_sqdist(x, centres)
            n = min(r, len(centres))
            lists = np.argsort(d, axis=1, kind="stable")[:, :n]
            diff = x[:, None, :] - centres[lists]
            exact = np.einsum("rkd,rkd->rk", diff, diff)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(exact.tolist(), pa.list_(pa.float64()))], names=["doc_id", "lists", "dists"])

    return run


def near_lists(rows: DataFrame, centroids: np.ndarray, r: int) -> DataFrame:
    """doc_id, lists, dists: the r nearest lists of every row, by (distance, list)."""
    shared = share(rows.sparkSession, centroids)
    return rows.select("doc_id", "x").mapInArrow(_near_lists(shared, r), "doc_id long, lists array<int>, dists array<double>")


class Greedy:
    """The balancing rule; its state is the projected size of each list."""

    def __init__(self, projected: dict[int, int], average: float, config: MergeConfig) -> None:
        self.projected, self.average, self.config = projected, average, config
        self.cap = average * config.hard_cap_ratio

    def penalty(self, p: int) -> float:
        """By how much one more row would lift a list above the average, in averages."""
        return max(0.0, self.projected.get(p, 0) + 1 - self.average) / max(1.0, self.average)

    def place(self, lists: list[int], dists: list[float]) -> int:
        """The list a row goes to; candidates come nearest first.

        Legal candidates are close enough and below the cap.  If the nearest
        list is overloaded, the cheapest legal one with less overload wins, if
        there is any; else the cheapest legal one; else the nearest.
        """
        reach, load = self.config.gamma * dists[0], self.penalty(lists[0])
        legal = [(d + self.config.lam * self.penalty(p), i, p) for i, (p, d) in enumerate(zip(lists, dists, strict=True)) if d <= reach and self.projected.get(p, 0) < self.cap]
        relief = [x for x in legal if load > 0 and self.penalty(x[2]) < load]
        chosen = min(relief or legal, default=(0.0, 0, lists[0]))[2]
        self.projected[chosen] = self.projected.get(chosen, 0) + 1
        return chosen


@dataclass(frozen=True)
class Assignment:
    """doc_id, list_id, dist of every recent row, and diagnostics."""

    rows: DataFrame
    moved_ratio: float
    avg_distance_ratio: float
    max_distance_ratio: float
    imbalance_before: float
    imbalance_after: float


def _ratio(sizes: dict[int, int], nlist: int) -> float:
    return max(sizes.values(), default=0) / max(1.0, sum(sizes.values()) / max(1, nlist))


#: Rows that one balanced assignment takes: its rule is sequential.  A larger delta is merged in parts.
MAX_SEQUENTIAL = 5_000_000


def assign_recent(recent: DataFrame, main: DataFrame, model: IvfModel, config: MergeConfig) -> Assignment:
    """Lists for all recent rows: the nearest ones, in parallel; or balanced ones, in the order of doc_id."""
    sizes = {r["list_id"]: r["n"] for r in partition_sizes(main, model.nlist).collect()}
    before = _ratio(sizes, model.nlist)
    if config.mode == "nearest":
        rows = assign(recent, model.centroids)
        for r in rows.groupBy("list_id").agg(F.count("*").alias("n")).collect():
            sizes[r["list_id"]] = sizes.get(r["list_id"], 0) + r["n"]
        return Assignment(rows, 0.0, 1.0, 1.0, before, _ratio(sizes, model.nlist))
    near = durable(near_lists(recent, model.centroids, config.top_r), "merge-near")
    delta = near.count()
    if delta > MAX_SEQUENTIAL:
        raise InvalidArgument(f"{delta} rows are more than {MAX_SEQUENTIAL}; merge them in parts")
    start = Greedy(dict(sizes), (sum(sizes.values()) + delta) / max(1, model.nlist), config)
    in_order = near.coalesce(1).sortWithinPartitions("doc_id")
    placed = durable(in_order.mapInArrow(_place(share(recent.sparkSession, start)), "doc_id long, list_id int, dist double, nearest double, moved boolean"), "merge-placed")
    ratio = F.when(F.col("nearest") > 0, F.col("dist") / F.col("nearest")).otherwise(1.0)
    facts = placed.agg(F.avg(F.col("moved").cast("double")).alias("moved"), F.avg(ratio).alias("mean"), F.max(ratio).alias("most")).first()
    for r in placed.groupBy("list_id").agg(F.count("*").alias("n")).collect():
        sizes[r["list_id"]] = sizes.get(r["list_id"], 0) + r["n"]
    return Assignment(placed.select("doc_id", "list_id", "dist"), facts["moved"] or 0.0, facts["mean"] or 1.0, max(1.0, facts["most"] or 1.0), before, _ratio(sizes, model.nlist))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy: Greedy = shared.value
        for batch in batches:
            out = []
            for doc_id, lists, dists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = greedy.place(lists, dists)
                out.append((doc_id, p, dists[lists.index(p)], dists[0], p != lists[0]))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "list_id", "dist", "nearest", "moved"])

    return run


def partition_stats(assigned: DataFrame, main: DataFrame) -> DataFrame:
    """list_id, inserts, main_size, growth, avg_residual of every list that receives rows."""
    old = main.groupBy("list_id").agg(F.count("*").alias("main_size"))
    new = assigned.groupBy("list_id").agg(F.count("*").alias("inserts"), F.avg("dist").alias("avg_residual"))
    size = F.coalesce("main_size", F.lit(0).cast("long"))
    return new.join(old, "list_id", "left").select("list_id", "inserts", size.alias("main_size"), (F.col("inserts") / F.greatest(size, F.lit(1))).alias("growth"), "avg_residual")


def score_partitions(stats: DataFrame, config: MergeConfig) -> DataFrame:
    """Adds score = alpha growth + beta residual, and whether the list is reordered."""
    score = config.alpha * F.col("growth") + config.beta * F.col("avg_residual")
    return stats.withColumn("score", score).withColumn("recluster", (F.col("inserts") > 0) & (F.col("score") >= config.threshold))


def list_order(postings: DataFrame, vectors: DataFrame, scored: DataFrame, model: IvfModel) -> DataFrame:
    """list_id, doc_id, position: by id, and in lists with ``recluster`` by (half, distance to its centre, id) of a local 2-means."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        if bool(pdf["recluster"].iloc[0]) and len(pdf) > 1:
            x = np.stack(pdf["x"]).astype(np.float64)
            centres = x[[0, len(x) - 1]].copy()
            for _ in range(5):
                side = fast_sqdist(x, centres).argmin(axis=1)
                for c in (0, 1):
                    if (side == c).any():
                        centres[c] = x[side == c].mean(axis=0)
            d = fast_sqdist(x, centres)
            order = np.lexsort((pdf["doc_id"], d.min(axis=1), d.argmin(axis=1)))
            pdf = pdf.iloc[order]
        return pd.DataFrame({"list_id": pdf["list_id"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "position": np.arange(len(pdf))})

    rows = postings.select("list_id", "doc_id").join(vectors.select("doc_id", "x"), "doc_id").join(scored.select("list_id", "recluster"), "list_id", "left").withColumn("recluster", F.coalesce("recluster", F.lit(False)))
    return rows.groupBy("list_id").applyInPandas(run, "list_id int, doc_id long, position long")


def list_neighbours(centroids: DataFrame, r: int) -> DataFrame:
    """list_id, neighbour, dist, rank of the r nearest lists of every list, itself among them at distance 0.

    ``centroids`` (list_id, c) is a model's table: a few thousand rows.
    """
    other = centroids.select(F.col("list_id").alias("neighbour"), F.col("c").alias("n"))
    pairs = centroids.crossJoin(F.broadcast(other)).select("list_id", "neighbour", l2sq("c", "n").alias("dist"))
    order = W.partitionBy("list_id").orderBy("dist", F.col("neighbour") != F.col("list_id"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= r)


def plan_neighbourhoods(centroids: np.ndarray, inserts: dict[int, int], top_r: int) -> dict[int, int]:
    """list to neighbourhood: seeds by number of inserts, each takes its top_r nearest lists that are still free, itself among them."""
    d = fast_sqdist(centroids, centroids)
    np.fill_diagonal(d, 0.0)
    taken: dict[int, int] = {}
    number = -1
    for seed in sorted((p for p in inserts if inserts[p] > 0), key=lambda p: (-inserts[p], p)):
        if seed in taken:
            continue
        number += 1
        order = [seed, *[int(p) for p in np.argsort(d[seed], kind="stable") if p != seed]][:top_r]
        taken |= {p: number for p in order if p not in taken}
    return taken


def repartition_neighbourhoods(recent: DataFrame, assigned: DataFrame, main: DataFrame, vectors: DataFrame, model: IvfModel, config: MergeConfig) -> DataFrame:
    """doc_id, list_id of all rows whose list is in a neighbourhood that receives rows.

    ``assigned`` (doc_id, list_id) says where recent rows go at first; lists are
    seeds of neighbourhoods by how many they receive.  Neighbourhoods run in parallel; inside one, main rows and then recent rows
    are dealt by the greedy rule with the neighbourhood's own average.
    """
    own = assigned.select("doc_id", "list_id")
    inserts = {r["list_id"]: r["n"] for r in own.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    plan = plan_neighbourhoods(model.centroids, inserts, config.top_r)
    shared = share(recent.sparkSession, (model.centroids, plan))
    table = recent.sparkSession.createDataFrame([(p, n) for p, n in plan.items()], "list_id int, hood int")
    old = main.select("doc_id", "list_id").join(vectors.select("doc_id", "x"), "doc_id").withColumn("recent", F.lit(0))
    new = own.join(recent.select("doc_id", "x"), "doc_id").withColumn("recent", F.lit(1))
    pool = old.unionByName(new).join(F.broadcast(table), "list_id").select("hood", "recent", "doc_id", "x")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centres, plan = shared.value
        lists = np.array(sorted(p for p, n in plan.items() if n == key[0]))
        pdf = pdf.sort_values(["recent", "doc_id"], ignore_index=True)
        d = fast_sqdist(np.stack(pdf["x"]).astype(np.float64), centres[lists])
        greedy = Greedy({}, len(pdf) / len(lists), config)
        out = []
        for row in d:
            order = np.argsort(row, kind="stable")
            out.append(greedy.place([int(lists[i]) for i in order], [float(row[i]) for i in order]))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "list_id": np.array(out, dtype=np.int32)})

    return pool.groupBy("hood").applyInPandas(run, "doc_id long, list_id int")


def finalize_codes(placed: DataFrame, before: DataFrame, vectors: DataFrame, model: IvfModel, reuse_safe: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings rows of the placed documents, a row with reused and encoded counts).

    A code is reused if the document already stood in the same list under these
    codebooks; all others are encoded from their vectors, which are fetched for
    those alone.
    """
    held = before.select("doc_id", F.col("list_id").alias("was"), "code")
    joined = placed.select("doc_id", "list_id").join(held, "doc_id", "left")
    same = F.lit(reuse_safe and model.is_pq) & (F.col("was") == F.col("list_id")) & F.col("code").isNotNull()
    kept = joined.where(F.coalesce(same, F.lit(False))).select("list_id", "doc_id", "code")
    todo = joined.where(~F.coalesce(same, F.lit(False))).select("doc_id", "list_id")
    fresh = encode(vectors.join(todo.select("doc_id"), "doc_id", "left_semi"), model, todo).select("list_id", "doc_id", "code")
    counts = joined.agg(F.count_if(F.coalesce(same, F.lit(False))).alias("reused"), F.count_if(~F.coalesce(same, F.lit(False))).alias("encoded"))
    return kept.unionByName(fresh).select(F.lit("main").alias("shard"), "list_id", "doc_id", "code"), counts


def commit_patch(main: DataFrame, patch: DataFrame, lists: list[int], prepared_generation: int, generation: int) -> DataFrame:
    """Main with the named lists replaced by the patch as a whole.

    Refused if the index moved on, if the patch names a document twice, puts
    rows outside its lists, or takes a document that an untouched list holds.
    """
    if prepared_generation != generation:
        raise Unavailable("the index changed since the patch was prepared")
    if patch.where(~F.col("list_id").isin(lists)).limit(1).count():
        raise InvalidArgument("the patch has rows outside its lists")
    if patch.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise InvalidArgument("the patch has a document twice")
    untouched = main.where(~F.col("list_id").isin(lists))
    if untouched.join(patch.select("doc_id"), "doc_id", "left_semi").limit(1).count():
        raise AlreadyExists("the patch has a document that an untouched list holds")
    return untouched.unionByName(patch.select(*main.columns))


@dataclass(frozen=True)
class MergeReport:
    rows: int
    lists: int
    moved_ratio: float
    imbalance_before: float
    imbalance_after: float
    reused: int
    encoded: int
    reordered: int = 0


@dataclass(frozen=True)
class PreparedMerge:
    """A patch of whole lists, and the generation of the index that it was made for."""

    patch: DataFrame
    lists: list[int]
    generation: int
    assigned: Assignment
    rows: int
    reused: int
    encoded: int
    reordered: int


def prepare(main: DataFrame, recent: DataFrame, vectors: DataFrame, model: IvfModel, config: MergeConfig | None = None, generation: int = 0) -> PreparedMerge:
    """All the work of a merge, without touching the index: ``recent`` has doc_id, ``vectors`` everything's x.

    Lists that receive rows are scored; those at the threshold or above are
    marked for reordering, whose order readers get from ``list_order``.
    """
    config = config or MergeConfig()
    rows = vectors.join(recent.select("doc_id"), "doc_id", "left_semi").select("doc_id", "x")
    assigned = assign_recent(rows, main, model, config)
    scored = score_partitions(partition_stats(assigned.rows, main), config)
    if config.mode == "balanced_append":
        placed = durable(repartition_neighbourhoods(rows, assigned.rows, main, vectors, model, config), "merge-lists")
        lists = [r[0] for r in main.select("doc_id", "list_id").join(placed.select("doc_id"), "doc_id", "left_semi").select("list_id").union(placed.select("list_id")).distinct().collect()]
    else:
        lists = [r[0] for r in assigned.rows.select("list_id").distinct().collect()]
        old = main.where(F.col("list_id").isin(lists)).select("doc_id", "list_id")
        placed = durable(old.unionByName(assigned.rows.select("doc_id", "list_id")), "merge-lists")
    patch, counts = finalize_codes(placed, main, vectors, model)
    n = counts.first()
    return PreparedMerge(durable(patch, "merge-patch"), [int(x) for x in lists], generation, assigned, rows.count(), n["reused"], n["encoded"], scored.where("recluster").count())


def commit(prepared: PreparedMerge, main: DataFrame, model: IvfModel, generation: int) -> tuple[DataFrame, MergeReport]:
    """Main with the patch in, if the index is still at the generation it was prepared for."""
    out = commit_patch(main, prepared.patch, prepared.lists, prepared.generation, generation)
    sizes = {r["list_id"]: r["n"] for r in partition_sizes(out, model.nlist).collect()}
    return out, MergeReport(prepared.rows, len(prepared.lists), prepared.assigned.moved_ratio, prepared.assigned.imbalance_before, _ratio(sizes, model.nlist), prepared.reused, prepared.encoded, prepared.reordered)


def merge(main: DataFrame, recent: DataFrame, vectors: DataFrame, model: IvfModel, config: MergeConfig | None = None, generation: int = 0, live: Callable[[], int] | None = None) -> tuple[DataFrame, MergeReport]:
    """Main postings with all recent postings in; ``live`` tells the index's generation when the patch is ready, which must still be the given one."""
    prepared = prepare(main, recent, vectors, model, config, generation)
    return commit(prepared, main, model, generation if live is None else live())


__all__ = ["Assignment", "Greedy", "MergeConfig", "MergeReport", "PreparedMerge", "assign_recent", "commit", "commit_patch", "finalize_codes", "list_order", "merge", "near_lists", "partition_stats", "plan_neighbourhoods", "postings_of", "prepare", "repartition_neighbourhoods", "score_partitions"]
