"""Recall, misses, percentiles, balance and throughput as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans.durable import durable


def recall_at_k(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, hits, recall: hits / k even where the truth has fewer rows; found is cut to rank k, truth is not."""
    hits = truth.select("query_id", "doc_id").join(found.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits")).withColumn("recall", F.col("hits") / k)


def mean_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    return recall_at_k(truth, found, k).agg(F.avg("recall").alias("recall"))


def age_recall(truth: DataFrame, found: DataFrame, new_begin: int, new_end: int) -> DataFrame:
    """One row: recall among new (doc in [new_begin, new_end)) and old truth rows, and the share of new ones.  An empty range has no new rows."""
    is_new = F.lit(False) if new_end <= new_begin else (F.col("doc_id") >= new_begin) & (F.col("doc_id") < new_end)
    rows = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left").withColumn("new", is_new)
    share = lambda c: F.coalesce(F.sum(F.when(c, F.coalesce("hit", F.lit(0)))) / F.count_if(c), F.lit(0.0))
    return rows.agg(share(F.col("new")).alias("recall_new"), share(~F.col("new")).alias("recall_old"), (F.count_if(F.col("new")) / F.count("*")).alias("new_ratio"))


def route_shares(found: DataFrame) -> DataFrame:
    """One row: how many final candidates came from the main and from recent shards."""
    return found.agg(F.count_if(F.col("from_new") == 0).alias("from_main"), F.count_if(F.col("from_new") == 1).alias("from_recent"), F.avg("from_new").alias("recent_share"))


def ranked_trace(trace: DataFrame) -> DataFrame:
    """A scan trace (query_id, doc_id, approx, exact) with both ranks from 1."""
    rank = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(c, "doc_id"))
    return trace.withColumn("approx_rank", rank("approx")).withColumn("exact_rank", rank("exact"))


def miss_diagnosis(truth: DataFrame, found: DataFrame, trace: DataFrame) -> DataFrame:
    """query_id, gt, probed, hits, not_probed, filtered, hits_on_probed, exact_hits, rank_loss.

    A missed truth row was either not in a probed list or probed and then
    filtered by its approximate distance; rank loss is how many ranks the
    approximation cost the filtered ones.
    """
    ranked = ranked_trace(trace).select("query_id", "doc_id", "approx_rank", "exact_rank")
    rows = truth.select("query_id", "doc_id").join(ranked, ["query_id", "doc_id"], "left").join(found.select("query_id", "doc_id", F.lit(True).alias("hit")), ["query_id", "doc_id"], "left")
    hit, probed = F.coalesce("hit", F.lit(False)), F.col("approx_rank").isNotNull()
    k = F.count("*")
    by_query = rows.withColumn("gt", F.count("*").over(W.partitionBy("query_id")))
    loss = F.greatest(F.lit(0), F.col("approx_rank") - F.col("exact_rank"))
    return by_query.groupBy("query_id").agg(
        k.alias("gt"),
        F.count_if(probed).alias("probed"),
        F.count_if(hit).alias("hits"),
        F.count_if(~hit & ~probed).alias("not_probed"),
        F.count_if(~hit & probed).alias("filtered"),
        F.count_if(hit & probed).alias("hits_on_probed"),
        F.count_if(probed & (F.col("exact_rank") <= F.col("gt"))).alias("exact_hits"),
        F.coalesce(F.sum(F.when(~hit & probed, loss)), F.lit(0)).cast("long").alias("rank_loss"),
    )


def miss_summary(diagnosis: DataFrame) -> DataFrame:
    """One row of macro averages over queries; the denominator is the truth's size."""
    ratio = lambda a: F.avg(F.col(a) / F.col("gt"))
    return diagnosis.agg(ratio("probed").alias("probed_rate"), F.avg(F.when(F.col("probed") > 0, F.col("hits_on_probed") / F.col("probed")).otherwise(0.0)).alias("recall_on_probed"), ratio("exact_hits").alias("exact_recall_on_probed"), (F.sum("rank_loss") / F.greatest(F.sum("filtered"), F.lit(1))).alias("rank_loss"))


def worst_queries(diagnosis: DataFrame, n: int = 10) -> DataFrame:
    return diagnosis.withColumn("recall", F.col("hits") / F.col("gt")).orderBy("recall", F.desc(F.col("not_probed") + F.col("filtered")), "query_id").limit(n)


def slowest_queries(latencies: DataFrame, n: int = 5) -> DataFrame:
    return latencies.orderBy(F.desc("latency_ms"), "query_id").limit(n)


# --- distributions -------------------------------------------------------


#: Slices of the values that one call ranks.
SLICES = 256


def _ranked(counts: DataFrame) -> DataFrame:
    """Adds ``__n``, all rows, and ``__upto``, the rows up to a value, to (__v, __c)."""
    cuts = counts.agg(F.sum("__c").alias("n"), F.percentile_approx("__v", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("cuts")).first()
    if cuts["n"] is None:
        return counts.withColumns({"__n": F.lit(0), "__upto": F.lit(0)})
    # As many cuts as are below a value: its slice.
    edges = F.array(*map(F.lit, sorted(set(cuts["cuts"]))))
    sliced = counts.withColumn("__s", F.size(F.filter(edges, lambda c: c < F.col("__v"))))
    below = sliced.groupBy("__s").agg(F.sum("__c").alias("__in")).withColumn("__below", F.coalesce(F.sum("__in").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__s", "__below")
    own = F.sum("__c").over(W.partitionBy("__s").orderBy("__v"))
    return sliced.join(F.broadcast(below), "__s").select("__v", "__c", F.lit(cuts["n"]).alias("__n"), (own + F.col("__below")).alias("__upto"))


def percentiles(df: DataFrame, value: str, quantiles: list[float], rule: str = "linear", by: list[str] | None = None) -> DataFrame:
    """One row a group: ``q0``, ``q1``, ... for the given quantiles.

    Rule ``linear`` interpolates between the two values around position
    q (n - 1) of the sorted values, ``floor`` takes the value at its floor.
    Rows are counted per distinct value first, so what is sorted is values and
    no list of rows is ever built.  Without groups the values are dealt to
    ``SLICES`` slices between approximate quantiles; slices are summed on their
    own and offset by those below, so no task sorts all values and ranks are exact.
    """
    if rule not in ("linear", "floor"):
        raise InvalidArgument("rule must be linear or floor")
    keys = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    if keys:
        counts = counts.join(counts.groupBy(*keys).agg(F.sum("__c").alias("__n")), keys)
        upto = counts.withColumn("__upto", F.sum("__c").over(W.partitionBy(*keys).orderBy("__v")))
    else:
        upto = _ranked(durable(counts, "values"))
    out = []
    for i, q in enumerate(quantiles):
        at = F.lit(q) * (F.col("__n") - 1)
        low, high = (F.min(F.when(F.col("__upto") > f(at), F.col("__v"))) for f in (F.floor, F.ceil))
        out.append((low if rule == "floor" else low + (high - low) * F.max(at - F.floor(at))).alias(f"q{i}"))
    return upto.groupBy(*keys).agg(*out)


def summary(df: DataFrame, value: str, rule: str = "linear", by: list[str] | None = None, quantiles: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """n, mean, min, percentiles, max by either rule."""
    keys = by or []
    ranks = percentiles(df, value, [q / 100 for q in quantiles], rule, by)
    basic = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    both = basic.join(ranks, keys, "left") if keys else basic.join(ranks, how="left")
    return both.select(*keys, "n", "mean", "min", *[F.col(f"q{i}").alias(f"p{q}") for i, q in enumerate(quantiles)], "max")


def imbalance(sizes: DataFrame, definition: str = "all", least_rows: int = 0) -> DataFrame:
    """One row: the ratio of the largest list to the average.

    ``all``: max / max(1, average over all lists); ``nonempty``: max / max(1,
    average over lists with rows); ``gated``: max / average over lists with
    rows, without a floor, and 0 below ``least_rows`` rows.
    """
    top, rows, filled = F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)
    if definition == "all":
        value = F.when(F.count("*") > 0, top / F.greatest(F.lit(1.0), rows / F.count("*"))).otherwise(0.0)
    elif definition == "nonempty":
        value = F.when(filled > 0, top / F.greatest(F.lit(1.0), rows / filled)).otherwise(0.0)
    elif definition == "gated":
        value = F.when((filled > 0) & (rows >= least_rows), top / (rows / filled)).otherwise(0.0)
    else:
        raise InvalidArgument("definition must be all, nonempty or gated")
    return sizes.agg(value.alias("imbalance"), top.cast("long").alias("largest"), filled.alias("filled"))


def scan_stats(scanned: DataFrame, seen_rows: int, k: int) -> DataFrame:
    s = summary(scanned, "scanned", quantiles=(50, 99))
    return s.select(F.col("mean").alias("scanned_avg"), F.col("p50").alias("scanned_p50"), F.col("p99").alias("scanned_p99"), F.col("max").alias("scanned_max"), (F.col("mean") / max(1, seen_rows)).alias("scan_ratio"), (F.col("mean") / k).alias("scanned_per_topk"))


def throughput(queries: int, seconds: float) -> float:
    """Queries a second of true wall time; 0 without time."""
    return queries / seconds if seconds > 0 else 0.0


def update_throughput(batches: DataFrame) -> DataFrame:
    """One row: vectors a second of the batches' own time, and amortised over maintenance too."""
    return batches.agg((F.sum("rows") / F.nullif(F.sum("update_s"), F.lit(0.0))).alias("update_vps"), (F.sum("rows") / F.nullif(F.sum("update_s") + F.sum("maintenance_s"), F.lit(0.0))).alias("amortised_vps"))


def latency_buckets(records: DataFrame, total_ms: float, width_ms: float = 200.0) -> DataFrame:
    """bucket, n, qps, mean, p50, p95, p99, max; the last bucket may be short, later records fall in it."""
    n = max(1, int(-(-total_ms // width_ms)))
    bucket = F.least(F.floor(F.col("completion_ms") / width_ms), F.lit(n - 1)).cast("int")
    length = F.when(F.col("bucket") == n - 1, F.lit((total_ms - (n - 1) * width_ms) / 1000)).otherwise(F.lit(width_ms / 1000))
    out = summary(records.withColumn("bucket", bucket), "latency_ms", by=["bucket"], quantiles=(50, 95, 99)).drop("min")
    return out.withColumn("qps", F.when(length > 0, F.col("n") / length).otherwise(0.0))


def queries_in_batches(records: DataFrame, batches: DataFrame, width_ms: float = 1000.0) -> DataFrame:
    """batch, n, mean_ms of the queries that complete within [start_ms, end_ms] of each batch.

    An interval join by time bins: both sides meet on equal bins, so neither is
    crossed with the other.
    """
    bins = batches.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_ms") / width_ms), F.floor(F.col("end_ms") / width_ms))))
    points = records.withColumn("bin", F.floor(F.col("completion_ms") / width_ms))
    met = bins.join(points, "bin").where((F.col("completion_ms") >= F.col("start_ms")) & (F.col("completion_ms") <= F.col("end_ms")))
    return batches.select("batch").join(met.groupBy("batch").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms")), "batch", "left").select("batch", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_ms")


def as_of_recall(records: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, version, recall of record rows (query_id, version, doc_ids) against the truth (version, query_id, doc_id) of their version, or of the last there is."""
    last = truth.agg(F.max("version").alias("last"))
    stamped = records.crossJoin(F.broadcast(last)).withColumn("judged", F.least("version", "last"))
    due = truth.groupBy(F.col("version").alias("judged"), "query_id").agg(F.collect_list("doc_id").alias("due"))
    joined = stamped.join(due, ["judged", "query_id"], "left")
    hits = F.size(F.array_intersect(F.slice("doc_ids", 1, k), F.coalesce("due", F.array().cast("array<long>"))))
    return joined.select("query_id", "version", (hits / k).alias("recall"))


def insert_progress(batches: DataFrame) -> DataFrame:
    """batch, progress in percent: (end - first end) / (last end - first end)."""
    w = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first("end_row").over(w), F.last("end_row").over(w)
    return batches.select("batch", F.when(last > first, 100.0 * (F.col("end_row") - first) / (last - first)).otherwise(100.0).alias("progress"))


def memory_estimate(postings: DataFrame, dim: int, m: int, nlist: int, words: int) -> DataFrame:
    """structure, bytes: what the tables of an index take."""
    n = F.count("*")
    return postings.agg(
        (n * (4 + 8 + m)).alias("postings"), (n * dim * 4).alias("vectors"), F.lit(nlist * dim * 8).cast("long").alias("centroids"), F.lit(words * dim * 8).cast("long").alias("codebooks")
    ).selectExpr("stack(4, 'postings', postings, 'vectors', vectors, 'centroids', centroids, 'codebooks', codebooks) as (structure, bytes)")


def insert_lag(batches: DataFrame, vectors_per_second: float) -> DataFrame:
    """batch, lag_ms: how far each batch ended behind the offered rate; batches have end_row and end_ms since the start."""
    if vectors_per_second <= 0:
        return batches.select("batch", F.lit(0.0).alias("lag_ms"))
    first = batches.agg(F.min("begin_row").alias("__first"))
    due = 1000.0 * (F.col("end_row") - F.col("__first")) / vectors_per_second
    return batches.crossJoin(F.broadcast(first)).select("batch", F.greatest(F.lit(0.0), F.col("end_ms") - due).alias("lag_ms"))


def counters(events: DataFrame) -> DataFrame:
    """One row: totals of online batches (nqe, ratio, drift, updated, deleted, rows)."""
    return events.agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("deleted").alias("deleted"), F.count_if("updated").alias("updates"), F.sum("nqe").alias("nqe_sum"), F.sum("ratio").alias("ratio_sum"), F.sum("drift").alias("drift_sum"), F.max("drift").alias("drift_max")
    )
