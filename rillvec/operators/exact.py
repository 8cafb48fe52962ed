"""Exact nearest neighbours: brute force over all rows, an id set, a prefix, or many prefixes.

Queries are a set whose number is checked before it is broadcast; beyond
``QUERY_BLOCK`` they are worked off in blocks, each of which passes over the
base once: meant for evaluation sets, not for tables of queries.  Base rows never meet in one task: every task keeps k candidates a
query, and only those are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import l2sq
from ..plans.shared import share

#: Queries that one pass over the base takes; 4096 of 128 doubles are 4 MB.
QUERY_BLOCK = 4096


def select_base(base: DataFrame, seen_rows: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows a search may see: ids below ``seen_rows``, and those in ``ids`` (doc_id)."""
    if seen_rows is not None:
        base = base.where(F.col("doc_id") < seen_rows)
    return base if ids is None else base.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def top_k(candidates: DataFrame, k: int, by: list[str] | None = None, key: str = "query_id") -> DataFrame:
    """The k first rows of each key in the given order, with their ``rank`` from 1."""
    order = [F.col(c) for c in (by or ["dist", "doc_id"])]
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def check_queries(queries: DataFrame) -> DataFrame:
    """The same queries, if there are few enough to broadcast at once."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise InvalidArgument(f"more than {QUERY_BLOCK} queries; use exact_topk")
    return queries


def exact_topk_columns(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, dist, rank by built-in expressions: the plain twin of the kernel, for one block of queries."""
    pairs = base.crossJoin(F.broadcast(check_queries(queries))).select("query_id", "doc_id", l2sq("q", "x").alias("dist"))
    return top_k(pairs, k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sqdist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of y; the direct form, one block of y at a time."""
    out = np.empty((len(x), len(y)))
    for j in range(len(y)):
        d = x - y[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def centred(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides less the mean of y: far from the origin squares would cancel."""
    shift = y.mean(axis=0) if len(y) else 0.0
    return x - shift, y - shift


def fast_sqdist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances through one matrix product; clamped at 0."""
    return rough_sqdist(x, y)[0]


def rough_sqdist(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and by how much a row's distances may be off: rounding follows the norms, not the distances."""
    x, y = centred(x, y)
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    off = 1e-15 * (x.shape[1] + 8) * (x2 + y2.max(initial=0.0))
    return np.maximum(0.0, x2[:, None] + y2[None, :] - 2.0 * x @ y.T), off[:, None]


def nearest_per_row(d: np.ndarray, k: int, off: np.ndarray, spare: int = 8) -> np.ndarray:
    """For each row a superset of its k least columns: those up to the k-th value, with rounding allowed for."""
    if d.shape[1] <= k + spare:
        return np.ones(d.shape, dtype=bool)
    return d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * off


def nearest_pairs(q: np.ndarray, x: np.ndarray, k: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, exact distance), the k nearest of every q among them; at most ``cells`` distances at a time."""
    found = []
    step = max(1, cells // max(1, len(q)))
    for at in range(0, len(x), step):
        block = x[at : at + step]
        d, off = rough_sqdist(q, block)
        at_q, at_x = np.nonzero(nearest_per_row(d, k, off))
        diff = q[at_q] - block[at_x]
        found.append((at_q, at_x + at, np.einsum("ij,ij->i", diff, diff)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_FOUND = "query_id long, part int, doc_id long, dist double"


def _scan(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        dist, group, doc = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            own, x, part = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
            found = [(dist, group, doc)]
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                at_q, at_x, exact = nearest_pairs(q, x[rows], k)
                found.append((exact, at_q + int(p) * len(ids), own[rows[at_x]]))
            dist, group, doc = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((doc, dist, group))
            order = order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < k]
            dist, group, doc = dist[order], group[order], doc[order]
        if len(dist):
            yield pa.RecordBatch.from_arrays([pa.array(ids[group % len(ids)]), pa.array((group // len(ids)).astype(np.int32)), pa.array(doc), pa.array(dist)], names=["query_id", "part", "doc_id", "dist"])

    return run


def _candidates(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, part, doc_id, dist: each task's k nearest rows (doc_id, x, part) of each query and part."""
    if k < 1:
        raise InvalidArgument("k must be 1 or more")
    spark = rows.sparkSession
    found = spark.createDataFrame([], _FOUND)
    for block in query_blocks(queries):
        found = found.unionAll(rows.mapInArrow(_scan(share(spark, block), k), _FOUND))
    return found


def exact_topk(base: DataFrame, queries: DataFrame, k: int, seen_rows: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, dist, rank of the k nearest rows, ties by doc_id.

    One pass over the base for each block of queries; each task emits at most
    k rows a query.
    """
    rows = select_base(base, seen_rows, ids).select("doc_id", "x", F.lit(0).alias("part"))
    return top_k(_candidates(rows, queries, k).drop("part"), k)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of consecutive blocks of queries, ordered by id; the driver holds one at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "q").orderBy("query_id").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield np.array(ids), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, dtype=np.float64)


def frontier_topk(base: DataFrame, queries: DataFrame, k: int, frontiers: list[int]) -> DataFrame:
    """frontier, query_id, doc_id, dist, rank: the exact top k among rows below each frontier.

    One pass: a row belongs to the first frontier above it, each interval keeps
    k rows a query, and a frontier ranks the intervals up to it.  A frontier
    with fewer than k rows has fewer ranks.
    """
    steps = sorted(set(frontiers))
    if not steps:
        raise InvalidArgument("no frontiers")
    limits = F.array(*map(F.lit, steps))
    below = F.size(F.filter(limits, lambda f: f <= F.col("doc_id")))
    kept = _candidates(select_base(base, steps[-1]).select("doc_id", "x", below.alias("part")), queries, k)
    every = kept.withColumn("at", F.explode(F.sequence("part", F.lit(len(steps) - 1)))).withColumn("frontier", F.get(limits, F.col("at")))
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "frontier").orderBy("dist", "doc_id")))
    return ranked.where(F.col("rank") <= k).select("frontier", "query_id", "doc_id", "dist", "rank")
