"""Several indexes as one: union of routes, one row a document, exact rerank, cut to k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import l2sq
from .exact import top_k
from .ivf import IvfModel, search_adc, search_flat


@dataclass(frozen=True)
class Route:
    """One searchable shard; ``from_new`` is 0 for the consolidated index and 1 for recent ones."""

    name: str
    model: IvfModel
    postings: DataFrame
    from_new: int
    budget: int = 0


def candidate_budget(own: int, shared: int) -> int:
    """Candidates a route hands to the rerank: its own budget, or the shared one where that is 0."""
    return own or shared


def search_route(route: Route, vectors: DataFrame, queries: DataFrame, k: int, nprobe: int, rerank: bool, shared_budget: int = 100) -> DataFrame:
    n = max(k, candidate_budget(route.budget, shared_budget)) if rerank else k
    if route.model.is_pq:
        found = search_adc(route.model, route.postings, queries, n, nprobe)
    else:
        found = search_flat(route.model, route.postings, vectors, queries, n, nprobe)
    return found.select("query_id", "doc_id", "approx", F.lit(route.from_new).alias("from_new"), F.lit(route.name).alias("route"))


def dedupe(candidates: DataFrame) -> DataFrame:
    """One row a query and document: that of least (approx, from_new)."""
    w = W.partitionBy("query_id", "doc_id").orderBy("approx", "from_new", "route")
    return candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``rerank``, the exact distance, by joining the vectors of the candidates only."""
    rows = candidates.join(vectors.select("doc_id", "x"), "doc_id").join(queries.select("query_id", "q"), "query_id")
    return rows.withColumn("rerank", l2sq("q", "x")).drop("q", "x")


def merge_routes(routes: list[DataFrame], k: int, queries: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, approx, from_new, route, rank (and rerank if vectors are given)."""
    if not routes:
        raise InvalidArgument("no routes")
    every = reduce(DataFrame.unionByName, routes)
    every = dedupe(every) if len(routes) > 1 else every
    if vectors is None:
        return top_k(every, k, ["approx", "doc_id"])
    return top_k(rerank(every, queries, vectors), k, ["rerank", "approx", "doc_id"])


def search(routes: list[Route], vectors: DataFrame, queries: DataFrame, k: int, nprobe: int, exact_rerank: bool = True, shared_budget: int = 100) -> DataFrame:
    """Multi-route search: candidates of each route, merged, reranked and cut to k."""
    if exact_rerank and shared_budget < k:
        raise InvalidArgument("the candidates of a route must be k or more")
    found = [search_route(r, vectors, queries, k, nprobe, exact_rerank, shared_budget) for r in routes]
    return merge_routes(found, k, queries if exact_rerank else None, vectors if exact_rerank else None)


def searchable_ids(routes: list[Route]) -> DataFrame:
    """doc_id of all rows in any route."""
    return reduce(DataFrame.union, [r.postings.select("doc_id") for r in routes]).distinct()


def coverage_faults(postings: DataFrame, rows: int) -> DataFrame:
    """doc_id, n of ids that are not held exactly once among 0 .. rows - 1; empty if coverage is exact."""
    held = postings.groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = postings.sparkSession.range(rows).select(F.col("id").alias("doc_id"), F.lit(True).alias("due"))
    return held.join(ids, "doc_id", "full_outer").where("n is null or n > 1 or due is null").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
