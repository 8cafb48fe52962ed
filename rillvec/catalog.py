"""The engine's queries over the driver's tables, each with SQL where SQL can say it.

Vectors are ``embeddings``; queries are the rows whose id is divisible by 100,
against all rows.  The small fixed model that oracles can rebuild takes its
eight centroids and sixteen codewords a subspace from the first rows by id.
"""

from __future__ import annotations


import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as vec
from .operators import exact, ivf, merge, metrics, mutate, routes, triggers, whitening
from .plans import concurrent, harness
from .plans.durable import durable, durable_dir
from .sources import artifacts
from .streaming import ingest

K, NLIST, NPROBE, M, WORDS, LAMBDA = 10, 8, 4, 8, 16, 0.5
#: Lists of the trained search index, and how many of them a query probes.
TRAINED, PROBED = 16, 14


def base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"))


def query_rows(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("x").alias("q"))


def flat_model(spark: SparkSession, d: str) -> ivf.IvfModel:
    return ivf.IvfModel(ivf.initial_rows(base(spark, d), NLIST))


def pq_model(spark: SparkSession, d: str) -> ivf.IvfModel:
    first = ivf.initial_rows(base(spark, d), WORDS)
    return ivf.IvfModel(first[:NLIST], LAMBDA * first.reshape(WORDS, M, -1).transpose(1, 0, 2))


def postings(spark: SparkSession, d: str, model: ivf.IvfModel) -> DataFrame:
    return ivf.postings_of(ivf.encode(base(spark, d), model))


def trained(spark: SparkSession, d: str, nlist: int = 16) -> tuple[ivf.IvfModel, DataFrame]:
    """A trained PQ index of every row: 16 lists, sixteen bytes a vector."""
    rows = durable(base(spark, d), "vectors")
    model = ivf.train(rows, nlist, 16, 8, iterations=8)
    return model, durable(ivf.postings_of(ivf.encode(rows, model)), "postings", by="list_id")


# --- SQL pieces ----------------------------------------------------------


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _sub(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


_W = 8
V = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
Q = "q AS (SELECT doc_id AS query_id, x AS q FROM v WHERE doc_id % 100 = 0)"
C = f"c AS (SELECT CAST(doc_id AS INTEGER) AS list_id, x AS c FROM v WHERE doc_id < {NLIST})"
A = f"a AS (SELECT doc_id, list_id, dist FROM (SELECT doc_id, list_id, {_l2('x', 'c')} AS dist FROM v, c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dist, list_id) = 1)"
E = f"e AS (SELECT query_id, doc_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM (SELECT query_id, doc_id, {_l2('q', 'x')} AS dist FROM q, v) QUALIFY rank <= {K})"
P = f"p AS (SELECT query_id, q, list_id, c FROM (SELECT query_id, q, list_id, c, {_l2('q', 'c')} AS d FROM q, c) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, list_id) <= {NPROBE})"
S = f"s AS (SELECT query_id, a.doc_id, a.list_id, {_l2('q', 'x')} AS approx FROM p JOIN a USING (list_id) JOIN v ON v.doc_id = a.doc_id)"
T = f"t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY approx, doc_id) AS rank FROM s QUALIFY rank <= {K})"
Z = f"z AS (SELECT m, CAST(doc_id AS INTEGER) AS k, list_transform(x[m * {_W} + 1:m * {_W} + {_W}], lambda y: {LAMBDA} * y) AS z FROM v, range({M}) AS r(m) WHERE doc_id < {WORDS})"
R = f"r AS (SELECT a.doc_id, a.list_id, m, ({_sub('x', 'c')})[m * {_W} + 1:m * {_W} + {_W}] AS r FROM a JOIN v USING (doc_id) JOIN c USING (list_id), range({M}) AS g(m))"
N = f"n AS (SELECT r.doc_id, list_id, r.m, k, err, {_dot('r', 'r')} AS energy FROM (SELECT r.doc_id, list_id, r.m, r, k, {_l2('r', 'z')} AS err FROM r JOIN z USING (m)) r QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.m ORDER BY err, k) = 1)"
D = f"d AS (SELECT query_id, n.doc_id, n.list_id, sum({_l2(f'({_sub("q", "c")})[n.m * {_W} + 1:n.m * {_W} + {_W}]', 'z')}) AS approx FROM p JOIN n USING (list_id) JOIN z ON z.m = n.m AND z.k = n.k GROUP BY ALL)"


def _with(*parts: str, tail: str) -> str:
    return f"WITH {', '.join(parts)} {tail}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- exact search --------------------------------------------------------

_EXACT = _with(V, Q, E, tail="SELECT query_id, doc_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM e")


@query("exact_topk", _EXACT)
def exact_topk(spark, d):
    return _rounded(exact.exact_topk(base(spark, d), query_rows(spark, d), K), "dist")


@query("exact_topk_columns", _EXACT)
def exact_topk_columns(spark, d):
    return _rounded(exact.exact_topk_columns(base(spark, d), query_rows(spark, d), K), "dist")


@query("exact_topk_sql", _EXACT)
def exact_topk_sql(spark, d):
    vec.register(spark)
    base(spark, d).createOrReplaceTempView("rillvec_base")
    exact.check_queries(query_rows(spark, d)).createOrReplaceTempView("rillvec_queries")
    return spark.sql(f"""
        SELECT query_id, doc_id, round(dist, 6) AS dist, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM (
            SELECT /*+ BROADCAST(q) */ query_id, doc_id, vec_l2sq(cast(q AS array<double>), cast(x AS array<double>)) AS dist FROM rillvec_base CROSS JOIN rillvec_queries q))
        WHERE rank <= {K}""")


@query("exact_topk_ids", _with(V, Q, f"e AS (SELECT query_id, doc_id, {_l2('q', 'x')} AS dist FROM q, v WHERE label < 5)", tail=f"SELECT query_id, doc_id, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS INTEGER) AS rank FROM e QUALIFY rank <= {K}"))
def exact_topk_ids(spark, d):
    ids = spark.read.parquet(f"{d}/embeddings.parquet").where("label < 5").select(F.col("vec_id").alias("doc_id"))
    return _rounded(exact.exact_topk(base(spark, d), query_rows(spark, d), K, ids=ids), "dist")


_FRONTIERS = "f AS (SELECT CAST(ceil(n * i / 4.0) AS INTEGER) AS frontier FROM (SELECT count(*) AS n FROM v), range(1, 5) AS r(i))"


@query("frontier_topk", _with(V, Q, _FRONTIERS, tail=f"SELECT frontier, query_id, doc_id, round({_l2('q', 'x')}, 6) AS dist, CAST(row_number() OVER (PARTITION BY frontier, query_id ORDER BY {_l2('q', 'x')}, doc_id) AS INTEGER) AS rank FROM f, q, v WHERE doc_id < frontier QUALIFY rank <= {K}"))
def frontier_topk(spark, d):
    n = base(spark, d).count()
    return _rounded(exact.frontier_topk(base(spark, d), query_rows(spark, d), K, [-(-n * i // 4) for i in range(1, 5)]), "dist")


# --- vector functions ----------------------------------------------------

_FUNCTIONS = _with(V, "c AS (SELECT x AS c FROM v WHERE doc_id = 0)", tail=f"""SELECT doc_id, round({_dot('x', 'x')}, 6) AS norm2, round({_dot('x', 'c')}, 6) AS dot, round({_l2('x', 'c')}, 6) AS l2sq,
    round(greatest(0, {_dot('x', 'x')} + {_dot('c', 'c')} - 2 * {_dot('x', 'c')}), 6) AS l2sq_by_norms, round(list_sum({_sub('x', 'c')}), 6) AS residual_sum, round(list_sum(x[9:16]), 6) AS part_sum,
    CASE WHEN {_dot('x', 'x')} > 0 THEN round(x[1] / sqrt({_dot('x', 'x')}), 6) ELSE 0 END AS unit_first FROM v, c""")


@query("vector_functions", _FUNCTIONS)
def vector_functions(spark, d):
    rows = base(spark, d).crossJoin(F.broadcast(base(spark, d).where("doc_id = 0").select(F.col("x").alias("c"))))
    by_norms = vec.l2sq_by_norms(vec.norm2("x"), vec.norm2("c"), vec.dot("x", "c"))
    out = rows.select("doc_id", vec.norm2("x").alias("norm2"), vec.dot("x", "c").alias("dot"), vec.l2sq("x", "c").alias("l2sq"), by_norms.alias("l2sq_by_norms"), vec.total(vec.residual("x", "c")).alias("residual_sum"), vec.total(vec.subvector(vec.as_double("x"), 1, 8)).alias("part_sum"), F.get(vec.normalize("x"), 0).alias("unit_first"))
    return _rounded(out, *out.columns[1:])


@query("vector_sql_functions", _FUNCTIONS)
def vector_sql_functions(spark, d):
    vec.register(spark)
    base(spark, d).selectExpr("doc_id", "cast(x AS array<double>) AS x").createOrReplaceTempView("rillvec_vectors")
    return spark.sql("""
        SELECT doc_id, round(vec_norm2(x), 6) AS norm2, round(vec_dot(x, c), 6) AS dot, round(vec_l2sq(x, c), 6) AS l2sq,
          round(greatest(0D, vec_norm2(x) + vec_norm2(c) - 2 * vec_dot(x, c)), 6) AS l2sq_by_norms,
          round(aggregate(vec_sub(x, c), 0D, (a, b) -> a + b), 6) AS residual_sum, round(aggregate(vec_slice(x, 1, 8), 0D, (a, b) -> a + b), 6) AS part_sum,
          round(get(vec_normalize(x), 0), 6) AS unit_first
        FROM rillvec_vectors CROSS JOIN (SELECT x AS c FROM rillvec_vectors WHERE doc_id = 0)""")


# --- lists ---------------------------------------------------------------

_ASSIGN = _with(V, C, A, tail="SELECT doc_id, list_id, round(dist, 6) AS dist FROM a")


@query("assign_lists", _ASSIGN)
def assign_lists(spark, d):
    return _rounded(ivf.assign(base(spark, d), flat_model(spark, d).centroids), "dist")


@query("assign_lists_columns", _ASSIGN)
def assign_lists_columns(spark, d):
    return _rounded(ivf.assign_columns(base(spark, d), flat_model(spark, d).centroid_table(spark)), "dist")


_SIZES = "z AS (SELECT list_id, count(a.doc_id) AS n FROM c LEFT JOIN a USING (list_id) GROUP BY list_id)"


@query("partition_sizes", _with(V, C, A, _SIZES, tail="SELECT list_id, n FROM z"))
def partition_sizes(spark, d):
    return ivf.partition_sizes(assign_lists(spark, d), NLIST)


@query("imbalance", _with(V, C, A, _SIZES, tail="""SELECT 'all' AS definition, round(max(n) / greatest(1, sum(n) / count(*)), 6) AS imbalance FROM z
  UNION ALL SELECT 'nonempty', round(max(n) / greatest(1, sum(n) / count(*) FILTER (n > 0)), 6) FROM z UNION ALL SELECT 'gated', round(max(n) / (sum(n) / count(*) FILTER (n > 0)), 6) FROM z"""))
def imbalance(spark, d):
    sizes = partition_sizes(spark, d)
    parts = [metrics.imbalance(sizes, x).select(F.lit(x).alias("definition"), F.round("imbalance", 6).alias("imbalance")) for x in ("all", "nonempty", "gated")]
    return parts[0].union(parts[1]).union(parts[2])


def _kmeans_sql(rounds: int) -> str:
    parts = [V, f"k0 AS (SELECT CAST(doc_id AS INTEGER) AS cid, x AS c FROM v WHERE doc_id < {NLIST})"]
    for i in range(rounds):
        near = f"SELECT doc_id, x, cid FROM (SELECT doc_id, x, cid, {_l2('x', 'c')} AS dist FROM v, k{i}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dist, cid) = 1"
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT cid, list(m ORDER BY j) AS c FROM (SELECT cid, j, avg(x[j]) AS m FROM ({near}), range(1, 65) AS r(j) GROUP BY cid, j) GROUP BY cid)")
    return _with(*parts, tail=f"SELECT cid, round(c[1], 5) AS first_value, round({_dot('c', 'c')}, 5) AS norm2 FROM k{rounds}")


@query("kmeans_rounds", _kmeans_sql(3))
def kmeans_rounds(spark, d):
    centres = ivf.kmeans(base(spark, d), NLIST, 3)
    return spark.createDataFrame([(i, float(c[0]), float(c @ c)) for i, c in enumerate(centres)], "cid int, first_value double, norm2 double").select("cid", F.round("first_value", 5).alias("first_value"), F.round("norm2", 5).alias("norm2"))


# --- product quantization ------------------------------------------------


@query("pq_encode", _with(V, C, A, Z, R, N, tail="SELECT doc_id, list_id, list(CAST(k AS VARCHAR) ORDER BY m)::VARCHAR AS code, round(sum(err), 6) AS err, round(sum(energy), 6) AS energy FROM n GROUP BY doc_id, list_id"))
def pq_encode(spark, d):
    out = ivf.encode(base(spark, d), pq_model(spark, d))
    return _rounded(out.select("doc_id", "list_id", F.concat(F.lit("["), F.array_join(F.col("code").cast("array<string>"), ", "), F.lit("]")).alias("code"), "err", "energy"), "err", "energy")


@query("pq_counts", _with(V, C, A, Z, R, N, tail="SELECT CAST(m AS INTEGER) AS m, k, count(*) AS n FROM n GROUP BY m, k"))
def pq_counts(spark, d):
    model = pq_model(spark, d)
    return ivf.code_counts(postings(spark, d, model), model).select("m", F.col("k").cast("int").alias("k"), "n")


@query("nqe_baseline", _with(V, C, A, Z, R, N, tail="SELECT round(avg(err / (energy + 1e-6)), 6) AS nqe, count(*) AS n FROM (SELECT sum(err) AS err, sum(energy) AS energy FROM n GROUP BY doc_id)"))
def nqe_baseline(spark, d):
    return _rounded(ivf.nqe_baseline(ivf.encode(base(spark, d), pq_model(spark, d))), "nqe")


def _pq_rounds_sql(rounds: int) -> str:
    parts = [V, C, A, R, f"k0 AS (SELECT m, doc_id AS k, r AS z FROM r WHERE doc_id < {WORDS})"]
    for i in range(rounds):
        near = f"SELECT doc_id, m, r, k FROM (SELECT r.doc_id, r.m, r, k, {_l2('r', 'z')} AS err FROM r JOIN k{i} USING (m)) QUALIFY row_number() OVER (PARTITION BY doc_id, m ORDER BY err, k) = 1"
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT k{i}.m, k{i}.k, coalesce(n.z, k{i}.z) AS z FROM k{i} LEFT JOIN (SELECT m, k, list(a ORDER BY j) AS z FROM (SELECT m, k, j, avg(r[j]) AS a FROM ({near}), range(1, {_W + 1}) AS g(j) GROUP BY m, k, j) GROUP BY m, k) n ON n.m = k{i}.m AND n.k = k{i}.k)")
    return _with(*parts, tail=f"SELECT CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, round(z[1], 5) + 0 AS first_value, round({_dot('z', 'z')}, 5) AS norm2 FROM k{rounds}")


@query("pq_train_rounds", _pq_rounds_sql(2))
def pq_train_rounds(spark, d):
    """Two rounds of codebook training over all rows, on executors."""
    model = flat_model(spark, d)
    first = ivf.initial_rows(base(spark, d), WORDS)
    start = (first - model.centroids[ivf.nearest(first, model.centroids)[0]]).reshape(WORDS, M, -1).transpose(1, 0, 2)
    books = ivf.pq_rounds(base(spark, d), model.centroids, start, 2)
    rows = [(m, k, float(z[0]), float(z @ z)) for m, book in enumerate(books) for k, z in enumerate(book)]
    out = spark.createDataFrame(rows, "m int, k int, first_value double, norm2 double")
    return out.select("m", "k", (F.round("first_value", 5) + 0).alias("first_value"), F.round("norm2", 5).alias("norm2"))


# --- approximate search --------------------------------------------------


@query("ivf_flat_search", _with(V, Q, C, A, P, S, T, tail="SELECT query_id, doc_id, list_id, round(approx, 6) AS approx, CAST(rank AS INTEGER) AS rank FROM t"))
def ivf_flat_search(spark, d):
    model = flat_model(spark, d)
    found = ivf.search_flat(model, postings(spark, d, model), base(spark, d), query_rows(spark, d), K, NPROBE)
    return _rounded(found.select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


_ADC = _with(V, Q, C, A, P, Z, R, N, D, tail=f"SELECT query_id, doc_id, list_id, round(approx, 6) AS approx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY approx, doc_id) AS INTEGER) AS rank FROM d QUALIFY rank <= {K}")


@query("adc_search", _ADC)
def adc_search(spark, d):
    model = pq_model(spark, d)
    return _rounded(ivf.search_adc(model, postings(spark, d, model), query_rows(spark, d), K, NPROBE).select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


@query("adc_search_precomputed", _ADC)
def adc_search_precomputed(spark, d):
    model = pq_model(spark, d)
    return _rounded(ivf.search_adc(model, postings(spark, d, model), query_rows(spark, d), K, NPROBE, precomputed=True).select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


@query("adc_search_columns", _ADC)
def adc_search_columns(spark, d):
    model = pq_model(spark, d)
    return _rounded(ivf.adc_columns(model, postings(spark, d, model), query_rows(spark, d), K, NPROBE).select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


@query("scan_trace", _with(V, Q, C, A, P, Z, R, N, D, tail="SELECT query_id, doc_id, list_id, round(approx, 6) AS approx FROM d"))
def scan_trace(spark, d):
    model = pq_model(spark, d)
    return _rounded(ivf.adc_candidates(model, postings(spark, d, model), query_rows(spark, d), K, NPROBE, trace=True), "approx")


_RERANK = f"k AS (SELECT query_id, doc_id, approx FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY approx, doc_id) <= 100), w AS (SELECT k.query_id, k.doc_id, approx, {_l2('q', 'x')} AS rerank FROM k JOIN q USING (query_id) JOIN v USING (doc_id))"


@query("rerank_search", _with(V, Q, C, A, P, Z, R, N, D, _RERANK, tail=f"SELECT query_id, doc_id, round(approx, 6) AS approx, round(rerank, 6) AS rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank, approx, doc_id) AS INTEGER) AS rank FROM w QUALIFY rank <= {K}"))
def rerank_search(spark, d):
    model = pq_model(spark, d)
    found = routes.search([routes.Route("main", model, postings(spark, d, model), 0)], base(spark, d), query_rows(spark, d), K, NPROBE)
    return _rounded(found.select("query_id", "doc_id", "approx", "rerank", "rank"), "approx", "rerank")


def _two_routes(spark, d) -> list[routes.Route]:
    """All rows, in two shards: labels below 5 are consolidated, the others recent; the shards meet on label 4."""
    model = flat_model(spark, d)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label")
    held = postings(spark, d, model).join(rows, "doc_id")
    columns = ["shard", "list_id", "doc_id", "code"]
    return [routes.Route("main", model, held.where("label < 5").select(*columns), 0), routes.Route("active", model, held.where("label >= 4").withColumn("shard", F.lit("active")).select(*columns), 1)]


_ROUTES = f"""u AS (SELECT query_id, s.doc_id, approx, from_new, route FROM s JOIN v USING (doc_id), (VALUES (0, 'main'), (1, 'active')) AS g(from_new, route) WHERE CASE from_new WHEN 0 THEN label < 5 ELSE label >= 4 END
  QUALIFY row_number() OVER (PARTITION BY query_id, route ORDER BY approx, s.doc_id) <= 100), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY approx, from_new) = 1),
  f AS (SELECT query_id, doc_id, from_new, route, {_l2('q', 'x')} AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY {_l2('q', 'x')}, approx, doc_id) AS rank FROM o JOIN q USING (query_id) JOIN v USING (doc_id) QUALIFY rank <= {K})"""


@query("multi_route_search", _with(V, Q, C, A, P, S, _ROUTES, tail="SELECT query_id, doc_id, from_new, route, round(rerank, 6) AS rerank, CAST(rank AS INTEGER) AS rank FROM f"))
def multi_route_search(spark, d):
    found = routes.search(_two_routes(spark, d), base(spark, d), query_rows(spark, d), K, NPROBE)
    return _rounded(found.select("query_id", "doc_id", "from_new", "route", "rerank", "rank"), "rerank")


@query("route_shares", _with(V, Q, C, A, P, S, _ROUTES, tail="SELECT count(*) FILTER (from_new = 0) AS from_main, count(*) FILTER (from_new = 1) AS from_recent, round(avg(from_new), 6) AS recent_share FROM f"))
def route_shares(spark, d):
    return _rounded(metrics.route_shares(multi_route_search(spark, d)), "recent_share")


@query("searchable_ids", _with(V, tail="SELECT doc_id FROM v"))
def searchable_ids(spark, d):
    return routes.searchable_ids(_two_routes(spark, d))


@query("coverage_faults", _with(V, tail="SELECT doc_id, CAST(2 AS BIGINT) AS n FROM v WHERE label = 4"))
def coverage_faults(spark, d):
    two = _two_routes(spark, d)
    return routes.coverage_faults(two[0].postings.unionByName(two[1].postings), base(spark, d).count())


def _searchable(spark: SparkSession, d: str) -> tuple[ivf.IvfModel, DataFrame]:
    """A trained index for search: ``TRAINED`` lists, and a code of a byte for every dimension."""
    rows = durable(base(spark, d), "vectors")
    model = ivf.train(rows, TRAINED, 64, 8, iterations=8)
    return model, durable(ivf.postings_of(ivf.encode(rows, model)), "postings", by="list_id")


@query("trained_adc_search")
def trained_adc_search(spark, d):
    model, held = _searchable(spark, d)
    return _rounded(ivf.search_adc(model, held, query_rows(spark, d), K, PROBED).select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


@query("trained_flat_search")
def trained_flat_search(spark, d):
    model, held = _searchable(spark, d)
    scan = durable(ivf.with_vectors(held, base(spark, d)), "scan", by="list_id")
    found = ivf.search_flat(model, scan, base(spark, d), query_rows(spark, d), K, PROBED)
    return _rounded(found.select("query_id", "doc_id", "list_id", "approx", "rank"), "approx")


@query("trained_rerank_search")
def trained_rerank_search(spark, d):
    model, held = _searchable(spark, d)
    found = routes.search([routes.Route("main", model, held, 0)], base(spark, d), query_rows(spark, d), K, PROBED, shared_budget=200)
    return _rounded(found.select("query_id", "doc_id", "approx", "rerank", "rank"), "approx", "rerank")


@query("trained_multi_route_search")
def trained_multi_route_search(spark, d):
    """Two shards of the trained index that meet on label 4."""
    model, held = _searchable(spark, d)
    held = held.join(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    columns = ["shard", "list_id", "doc_id", "code"]
    two = [routes.Route("main", model, held.where("label < 5").select(*columns), 0), routes.Route("active", model, held.where("label >= 4").withColumn("shard", F.lit("active")).select(*columns), 1)]
    found = routes.search(two, base(spark, d), query_rows(spark, d), K, PROBED, shared_budget=200)
    return _rounded(found.select("query_id", "doc_id", "from_new", "route", "rerank", "rank"), "rerank")


@query("trained_search_recall")
def trained_search_recall(spark, d):
    """Recall of a trained index with exact rerank, against brute force, by number of probed lists."""
    model, held = trained(spark, d)
    rows, q = base(spark, d), query_rows(spark, d)
    truth = durable(exact.exact_topk(rows, q, K), "truth")
    out = None
    for nprobe in (1, 4, 8, 12, 16):
        found = routes.search([routes.Route("main", model, held, 0)], rows, q, K, nprobe, shared_budget=200)
        part = metrics.mean_recall(truth, found, K).select(F.lit(nprobe).alias("nprobe"), "recall")
        out = part if out is None else out.unionAll(part)
    return out


# --- evaluation ----------------------------------------------------------

_HIT = "h AS (SELECT e.query_id, e.doc_id, t.doc_id IS NOT NULL AS hit FROM e LEFT JOIN t ON t.query_id = e.query_id AND t.doc_id = e.doc_id)"


def _truth_and_found(spark, d) -> tuple[DataFrame, DataFrame]:
    return exact.exact_topk(base(spark, d), query_rows(spark, d), K), ivf_flat_search(spark, d)


@query("recall_at_k", _with(V, Q, E, C, A, P, S, T, _HIT, tail=f"SELECT query_id, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / {K} AS recall FROM h GROUP BY query_id"))
def recall_at_k(spark, d):
    return metrics.recall_at_k(*_truth_and_found(spark, d), K)


@query("age_recall", _with(V, Q, E, C, A, P, S, T, _HIT, "b AS (SELECT count(*) // 2 AS cut FROM v)", tail="SELECT round(coalesce(avg(CAST(hit AS INTEGER)) FILTER (doc_id >= cut), 0), 6) AS recall_new, round(coalesce(avg(CAST(hit AS INTEGER)) FILTER (doc_id < cut), 0), 6) AS recall_old, round(count(*) FILTER (doc_id >= cut) / count(*), 6) AS new_ratio FROM h, b"))
def age_recall(spark, d):
    n = base(spark, d).count()
    return _rounded(metrics.age_recall(*_truth_and_found(spark, d), n // 2, n), "recall_new", "recall_old", "new_ratio")


_DIAG = f"""y AS (SELECT d.query_id, d.doc_id, row_number() OVER (PARTITION BY d.query_id ORDER BY approx, d.doc_id) AS ar, row_number() OVER (PARTITION BY d.query_id ORDER BY {_l2('q', 'x')}, d.doc_id) AS er FROM d JOIN q USING (query_id) JOIN v USING (doc_id)),
  g AS (SELECT e.query_id, ar, er, coalesce(ar <= {K}, false) AS hit, count(*) OVER (PARTITION BY e.query_id) AS gt FROM e LEFT JOIN y USING (query_id, doc_id)),
  x AS (SELECT query_id, count(*) AS gt, count(ar) AS probed, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND ar IS NULL) AS not_probed, count(*) FILTER (NOT hit AND ar IS NOT NULL) AS filtered,
    count(*) FILTER (hit AND ar IS NOT NULL) AS hits_on_probed, count(*) FILTER (er <= gt) AS exact_hits, CAST(coalesce(sum(greatest(0, ar - er)) FILTER (NOT hit AND ar IS NOT NULL), 0) AS BIGINT) AS rank_loss FROM g GROUP BY query_id)"""
_DIAG_ALL = (V, Q, E, C, A, P, Z, R, N, D, _DIAG)


@query("miss_diagnosis", _with(*_DIAG_ALL, tail="SELECT * FROM x"))
def miss_diagnosis(spark, d):
    model, q = pq_model(spark, d), query_rows(spark, d)
    held = postings(spark, d, model)
    trace = ivf.adc_candidates(model, held, q, K, NPROBE, trace=True).join(base(spark, d), "doc_id").join(F.broadcast(q), "query_id").select("query_id", "doc_id", "approx", vec.l2sq("q", "x").alias("exact"))
    truth = exact.exact_topk(base(spark, d), q, K)
    return metrics.miss_diagnosis(truth, ivf.search_adc(model, held, q, K, NPROBE), trace)


@query("miss_summary", _with(*_DIAG_ALL, tail="SELECT round(avg(probed / gt), 6) AS probed_rate, round(avg(CASE WHEN probed > 0 THEN hits_on_probed / probed ELSE 0 END), 6) AS recall_on_probed, round(avg(exact_hits / gt), 6) AS exact_recall_on_probed, round(sum(rank_loss) / greatest(sum(filtered), 1), 6) AS rank_loss FROM x"))
def miss_summary(spark, d):
    out = metrics.miss_summary(miss_diagnosis(spark, d))
    return _rounded(out, *out.columns)


@query("worst_queries", _with(*_DIAG_ALL, tail="SELECT query_id, hits, hits / gt AS recall FROM x ORDER BY hits / gt, not_probed + filtered DESC, query_id LIMIT 10"))
def worst_queries(spark, d):
    return metrics.worst_queries(miss_diagnosis(spark, d)).select("query_id", "hits", "recall")


@query("scan_stats", _with(V, Q, C, A, P, "s AS (SELECT query_id, count(a.doc_id) AS n FROM p LEFT JOIN a USING (list_id) GROUP BY query_id)", tail=f"SELECT round(avg(n), 6) AS scanned_avg, quantile_cont(n, 0.5) AS scanned_p50, round(quantile_cont(n, 0.99), 6) AS scanned_p99, max(n) AS scanned_max, round(avg(n) / (SELECT count(*) FROM v), 6) AS scan_ratio, round(avg(n) / {K}, 6) AS scanned_per_topk FROM s"))
def scan_stats(spark, d):
    model = flat_model(spark, d)
    n = ivf.scanned(query_rows(spark, d), model.centroid_table(spark), postings(spark, d, model), NPROBE, NLIST)
    return _rounded(metrics.scan_stats(n, base(spark, d).count(), K), "scanned_avg", "scanned_p99", "scan_ratio", "scanned_per_topk")


# --- logs ----------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    """``events`` as query records: completion in ms since the first, value as latency."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.agg(F.min("ts").alias("t0"))
    return e.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("query_id"), ((F.unix_micros("ts") - F.unix_micros("t0")) / 1000).alias("completion_ms"), F.col("value").alias("latency_ms"), "event_type")


_LOG = "l AS (SELECT event_id AS query_id, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000.0 AS completion_ms, value AS latency_ms, event_type FROM events)"
_HOUR = 3_600_000.0


def _stats_sql(at: str) -> str:
    return "SELECT event_type, count(*) AS n, round(avg(latency_ms), 6) AS mean, min(latency_ms) AS min, " + ", ".join(f"round({at.format(q=q / 100)}, 6) AS p{q}" for q in (50, 90, 95, 99)) + ", max(latency_ms) AS max FROM l GROUP BY event_type"


@query("percentiles_linear", _with(_LOG, tail=_stats_sql("quantile_cont(latency_ms, {q})")))
def percentiles_linear(spark, d):
    return _rounded(metrics.summary(_records(spark, d), "latency_ms", "linear", ["event_type"]), "p50", "p90", "p95", "p99").withColumn("mean", F.round("mean", 6))


@query("percentiles_floor", _with(_LOG, tail=_stats_sql("list_sort(list(latency_ms))[CAST(floor(CAST({q} AS DOUBLE) * (count(*) - 1)) AS INTEGER) + 1]")))
def percentiles_floor(spark, d):
    return _rounded(metrics.summary(_records(spark, d), "latency_ms", "floor", ["event_type"]), "p50", "p90", "p95", "p99").withColumn("mean", F.round("mean", 6))


@query("latency_buckets", _with(_LOG, f"b AS (SELECT *, CAST(least(floor(completion_ms / {_HOUR}), 23) AS INTEGER) AS bucket FROM l)", tail=f"SELECT bucket, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, max(latency_ms) AS max, round(count(*) / {_HOUR / 1000}, 6) AS qps FROM b GROUP BY bucket"))
def latency_buckets(spark, d):
    out = metrics.latency_buckets(_records(spark, d), 24 * _HOUR, _HOUR)
    return _rounded(out, "p50", "p95", "p99", "qps").withColumn("mean", F.round("mean", 6))


_BATCHES = "b AS (SELECT i AS batch, i * 5400000.0 AS start_ms, i * 5400000.0 + 7200000.0 AS end_ms, CAST(1000 * (i + 1) AS BIGINT) AS end_row FROM range(16) AS r(i))"


def _batches(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(16).select(i.alias("batch"), (i * 5400000.0).alias("start_ms"), (i * 5400000.0 + 7200000.0).alias("end_ms"), (1000 * (i + 1)).alias("end_row"))


@query("queries_in_batches", _with(_LOG, _BATCHES, tail="SELECT batch, count(query_id) AS n, round(avg(latency_ms), 6) AS mean_ms FROM b LEFT JOIN l ON completion_ms BETWEEN start_ms AND end_ms GROUP BY batch"))
def queries_in_batches(spark, d):
    return metrics.queries_in_batches(_records(spark, d), _batches(spark), _HOUR).withColumn("mean_ms", F.round("mean_ms", 6))


@query("insert_progress", _with(_BATCHES, tail="SELECT batch, round(100.0 * (end_row - 1000) / 15000, 6) AS progress FROM b"))
def insert_progress(spark, d):
    return _rounded(metrics.insert_progress(_batches(spark)), "progress")


@query("as_of_recall", _with(V, Q, E, _FRONTIERS, f"g AS (SELECT row_number() OVER (ORDER BY frontier) - 1 AS version, frontier FROM f), w AS (SELECT version, query_id, doc_id FROM g, q, v WHERE doc_id < frontier QUALIFY row_number() OVER (PARTITION BY version, query_id ORDER BY {_l2('q', 'x')}, doc_id) <= {K})", tail=f"SELECT r.query_id, CAST(r.version AS BIGINT) AS version, count(w.doc_id) / {K} AS recall FROM (SELECT query_id, doc_id, query_id // 100 % 6 AS version FROM e) r LEFT JOIN w ON w.version = least(r.version, 3) AND w.query_id = r.query_id AND w.doc_id = r.doc_id GROUP BY r.query_id, r.version"))
def as_of_recall(spark, d):
    truth = frontier_topk(spark, d)
    steps = sorted(r[0] for r in truth.select("frontier").distinct().collect())
    version = F.array_position(F.array(*map(F.lit, steps)), F.col("frontier")) - 1
    found = exact.exact_topk(base(spark, d), query_rows(spark, d), K).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    records = found.select("query_id", F.pmod(F.floor(F.col("query_id") / 100), F.lit(6)).alias("version"), F.col("r.doc_id").alias("doc_ids"))
    return metrics.as_of_recall(records, truth.select(version.alias("version"), "query_id", "doc_id"), K)


# --- transforms ----------------------------------------------------------


@query("whitening_moments", _with(V, tail="SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(avg(x[i] * x[j]) - avg(x[i]) * avg(x[j]), 6) + 0 AS cov FROM v, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j"))
def whitening_moments(spark, d):
    cov = whitening.moments(base(spark, d)).covariance
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))], "i int, j int, cov double").withColumn("cov", F.round("cov", 6) + F.lit(0.0))


@query("whitening_roundtrip", _with(V, tail="SELECT doc_id, round(x[1], 4) + 0 AS first_value FROM v"))
def whitening_roundtrip(spark, d):
    w = whitening.Whitening()
    t = w.get(w.fit(base(spark, d)))
    back = t.unapply(t.apply(base(spark, d)))
    return back.select("doc_id", (F.round(F.get("x", 0), 4) + F.lit(0.0)).alias("first_value"))


def _form_sql(x: str = "x") -> tuple[str, ...]:
    """Rows y, centred as a transform fitted on ``x`` centres them, and covariance rows: |transform(y)|^2 is their quadratic form."""
    return (
        f"s AS (SELECT {x} AS x FROM v)",
        "k AS (SELECT i, list(cov ORDER BY j) AS c FROM (SELECT i, j, avg(x[i] * x[j]) - avg(x[i]) * avg(x[j]) AS cov FROM s, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j) GROUP BY i)",
        "mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM s, range(1, 65) AS a(i) GROUP BY i))",
        f"y AS (SELECT doc_id, {_sub('x', 'm')} AS y FROM v, mu)",
        f"e AS (SELECT doc_id, sum(y[i] * {_dot('c', 'y')}) AS energy FROM y, k GROUP BY doc_id)",
    )


@query("normalized_space", _with(V, *_form_sql(), f"o AS (SELECT y AS o FROM y WHERE doc_id = 0), l AS (SELECT doc_id, sum(o[i] * {_dot('c', 'y')}) AS d FROM y, k, o GROUP BY doc_id)", tail="SELECT doc_id, 1.0::DOUBLE AS length, round(d / sqrt(energy * (SELECT energy FROM e WHERE doc_id = 0)), 6) + 0 AS likeness FROM l JOIN e USING (doc_id)"))
def normalized_space(spark, d):
    """Rows in a space of unit length: their length, and their cosine with the first row."""
    w = whitening.Whitening(cosine=True)
    t = w.get(w.fit(base(spark, d)))
    rows = t.apply(base(spark, d))
    first = rows.where("doc_id = 0").select(F.col("x").alias("o"))
    return rows.crossJoin(F.broadcast(first)).select("doc_id", F.round(F.sqrt(vec.norm2("x")), 6).alias("length"), (F.round(vec.dot("x", "o"), 6) + F.lit(0.0)).alias("likeness"))


@query("transform_squared", _with(V, *_form_sql(), tail="SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(c[j], 6) + 0 AS cov FROM k, range(1, 65) AS b(j)"))
def transform_squared(spark, d):
    """The matrix of the default transform, times itself, is the covariance."""
    w = whitening.Whitening()
    t = w.get(w.fit(base(spark, d))).matrix
    square = t @ t
    return spark.createDataFrame([(i, j, float(square[i, j])) for i in range(len(square)) for j in range(len(square))], "i int, j int, cov double").withColumn("cov", F.round("cov", 6) + F.lit(0.0))


# --- changes -------------------------------------------------------------


@query("insert_faults", _with(V, tail="SELECT doc_id, 'duplicate' AS fault FROM v WHERE label = 1 UNION ALL SELECT doc_id, 'present' FROM v WHERE label < 2"))
def insert_faults(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"), "label")
    batch = rows.where("label < 2").unionAll(rows.where("label = 1"))
    return mutate.insert_faults(batch, postings(spark, d, flat_model(spark, d)), 64)


@query("delete_faults", _with(V, tail="SELECT doc_id + 1000000 AS doc_id, 'unknown' AS fault FROM v WHERE label = 3"))
def delete_faults(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    ids = rows.where("label = 3").select((F.col("vec_id") + 1_000_000).alias("doc_id")).unionAll(rows.where("label = 2").select("vec_id"))
    return mutate.delete_faults(ids, postings(spark, d, flat_model(spark, d)))


_UPDATE = f"""b AS (SELECT m, k, count(*) AS n, list(r) AS rs FROM n JOIN r USING (doc_id, m) GROUP BY m, k),
  u AS (SELECT z.m, z.k, z, coalesce(n, 0) AS n, [CASE WHEN n IS NULL THEN z[j] ELSE (10 * z[j] + list_sum(list_transform(rs, lambda y: y[j]))) / (10 + n) END FOR j IN range(1, {_W + 1})] AS zz FROM z LEFT JOIN b ON b.m = z.m AND b.k = z.k)"""


@query("online_update", _with(V, C, A, Z, R, N, _UPDATE, tail="SELECT CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, CAST(10 + n AS BIGINT) AS n, round(list_sum(zz), 6) + 0 AS word_sum FROM u"))
def online_update(spark, d):
    """One codebook update by all rows, from ten earlier rows under each codeword."""
    model = pq_model(spark, d)
    added = mutate.batch_sums(base(spark, d), model)
    state = mutate.OnlineState(np.full((M, WORDS), 10))
    z, n, _ = mutate.update_codebooks(model, state, added, None, mutate.OnlineConfig())
    rows = [(m, k, int(n[m, k]), float(z[m, k].sum())) for m in range(M) for k in range(WORDS)]
    return spark.createDataFrame(rows, "m int, k int, n long, word_sum double").withColumn("word_sum", F.round("word_sum", 6) + F.lit(0.0))


@query("sliding_window", _with(V, tail="SELECT doc_id FROM v ORDER BY doc_id LIMIT greatest(0, (SELECT count(*) FROM v) + 50 - 400)"))
def sliding_window(spark, d):
    order = base(spark, d).select("doc_id", F.col("doc_id").alias("insert_seq"))
    return mutate.window_expired(order, 50, 400)


@query("merge_nearest", _with(V, C, A, tail="SELECT doc_id, list_id FROM a"))
def merge_nearest(spark, d):
    """Merging the rows of labels 5 to 9 into an index of the others leaves every row in its nearest list."""
    two, rows = _two_routes(spark, d), base(spark, d)
    recent = two[1].postings.join(two[0].postings.select("doc_id"), "doc_id", "left_anti")
    out, _ = merge.merge(durable(two[0].postings, "main"), durable(recent, "recent"), rows, two[0].model, merge.MergeConfig(mode="nearest"))
    return out.select("doc_id", "list_id")


@query("merge_balanced")
def merge_balanced(spark, d):
    two, rows = _two_routes(spark, d), base(spark, d)
    recent = two[1].postings.join(two[0].postings.select("doc_id"), "doc_id", "left_anti")
    out, _ = merge.merge(durable(two[0].postings, "main"), durable(recent, "recent"), rows, two[0].model, merge.MergeConfig(gamma=1.2, top_r=4))
    return out.select("doc_id", "list_id")


@query("partition_scores", _with(V, C, A, "g AS (SELECT list_id, count(*) FILTER (label >= 5) AS inserts, count(*) FILTER (label < 5) AS main_size, avg(dist) FILTER (label >= 5) AS avg_residual FROM a JOIN v USING (doc_id) GROUP BY list_id)", tail="SELECT list_id, inserts, main_size, round(inserts / greatest(main_size, 1), 6) AS growth, round(avg_residual, 6) AS avg_residual, round(inserts / greatest(main_size, 1) + 0.5 * avg_residual, 6) AS score, inserts / greatest(main_size, 1) + 0.5 * avg_residual >= 1.5 AS recluster FROM g WHERE inserts > 0"))
def partition_scores(spark, d):
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label")
    held = ivf.assign(base(spark, d), flat_model(spark, d).centroids).join(labels, "doc_id")
    scored = merge.score_partitions(merge.partition_stats(held.where("label >= 5"), held.where("label < 5")), merge.MergeConfig(beta=0.5, threshold=1.5))
    return _rounded(scored, "growth", "avg_residual", "score")


@query("memory_estimate", _with(V, tail=f"SELECT unnest(['postings', 'vectors', 'centroids', 'codebooks']) AS structure, unnest([count(*) * {12 + M}, count(*) * 256, {NLIST * 64 * 8}, {WORDS * 64 * 8}]) AS bytes FROM v"))
def memory_estimate(spark, d):
    return metrics.memory_estimate(postings(spark, d, pq_model(spark, d)), 64, M, NLIST, WORDS)


@query("near_lists", _with(V, C, tail=f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_l2('x', 'c')}, list_id) AS INTEGER) AS rank, list_id, round({_l2('x', 'c')}, 6) AS dist FROM v, c QUALIFY rank <= 4"))
def near_lists(spark, d):
    """The four nearest lists of every row: the candidates of a balanced merge."""
    near = merge.near_lists(base(spark, d), flat_model(spark, d).centroids, 4)
    rows = near.select("doc_id", F.posexplode(F.arrays_zip("lists", "dists")).alias("place", "l"))
    return rows.select("doc_id", (F.col("place") + 1).alias("rank"), F.col("l.lists").alias("list_id"), F.round("l.dists", 6).alias("dist"))


@query("list_neighbours", _with(V, C, "o AS (SELECT list_id AS neighbour, c AS n FROM c)", tail=f"SELECT list_id, neighbour, round({_l2('c', 'n')}, 6) AS dist, CAST(row_number() OVER (PARTITION BY list_id ORDER BY {_l2('c', 'n')}, neighbour <> list_id, neighbour) AS INTEGER) AS rank FROM c, o QUALIFY rank <= 4"))
def list_neighbours(spark, d):
    return _rounded(merge.list_neighbours(flat_model(spark, d).centroid_table(spark), 4), "dist")


@query("code_reuse", _with(V, C, A, tail="SELECT count(*) FILTER (label < 5 AND list_id % 2 = 0) AS reused, count(*) FILTER (label >= 5 OR list_id % 2 = 1) AS encoded FROM a JOIN v USING (doc_id)"))
def code_reuse(spark, d):
    """Codes that a merge keeps: rows that held one and stay in their list; here odd lists all move up by two."""
    model = pq_model(spark, d)
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label")
    held = postings(spark, d, model).join(labels, "doc_id")
    moved = F.when(F.col("list_id") % 2 == 1, (F.col("list_id") + 2) % NLIST).otherwise(F.col("list_id")).cast("int")
    _, counts = merge.finalize_codes(held.select("doc_id", moved.alias("list_id")), held.where("label < 5").select("shard", "list_id", "doc_id", "code"), base(spark, d), model)
    return counts


@query("fresh_codes_after_merge", _with(V, tail="SELECT doc_id, true AS same FROM v"))
def fresh_codes_after_merge(spark, d):
    """After a merge, every row's code is what encoding it anew would give."""
    model, rows = pq_model(spark, d), durable(base(spark, d), "rows")
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label")
    held = postings(spark, d, model).join(labels, "doc_id")
    main = durable(held.where("label < 5").select("shard", "list_id", "doc_id", "code"), "main")
    out, _ = merge.merge(main, held.where("label >= 5").select("doc_id"), rows, model, merge.MergeConfig(gamma=1.2))
    out = durable(out, "merged")
    again = ivf.encode(rows, model, out).select("doc_id", F.col("code").alias("anew"))
    return out.join(again, "doc_id").select("doc_id", (F.col("code") == F.col("anew")).alias("same"))


@query("slowest_queries", _with(_LOG, tail="SELECT query_id, latency_ms FROM l ORDER BY latency_ms DESC, query_id LIMIT 5"))
def slowest_queries(spark, d):
    return metrics.slowest_queries(_records(spark, d)).select("query_id", "latency_ms")


@query("insert_lag", _with(_BATCHES, tail="SELECT batch, greatest(0, end_ms - 1000.0 * end_row / 0.2) AS lag_ms FROM b"))
def insert_lag(spark, d):
    return metrics.insert_lag(_batches(spark).withColumn("begin_row", F.col("end_row") - 1000), 0.2)


@query("update_throughput", _with("b AS (SELECT label, count(*) AS rows, 1.0 + label AS update_s, 2.0 AS maintenance_s FROM embeddings GROUP BY label)", tail="SELECT round(sum(rows) / sum(update_s), 6) AS update_vps, round(sum(rows) / sum(update_s + maintenance_s), 6) AS amortised_vps FROM b"))
def update_throughput(spark, d):
    b = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("rows")).select("rows", (1.0 + F.col("label")).alias("update_s"), F.lit(2.0).alias("maintenance_s"))
    return _rounded(metrics.update_throughput(b), "update_vps", "amortised_vps")


@query("merge_triggers", """
WITH s AS (SELECT label, count(*) AS rows, count(*) / 100.0 AS share, avg(embedding[1]) AS drift FROM embeddings GROUP BY label)
SELECT label, rows >= 50 OR share >= 0.55 AS fires, CASE WHEN rows >= 50 AND share >= 0.55 THEN 'delta_full+delta_main_ratio' WHEN rows >= 50 THEN 'delta_full' WHEN share >= 0.55 THEN 'delta_main_ratio' ELSE 'none' END AS reason FROM s""")
def merge_triggers(spark, d):
    """Would a delta of each label's rows be merged into a main index of a hundred?"""
    trigger = triggers.MergeTrigger("hybrid", rows=50, train_rows=10, delta_main_ratio=0.55)
    counts = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    made = [(r["label"], *(lambda x: (x.fires, x.reason))(trigger.decide(r["n"], 100))) for r in counts]
    return spark.createDataFrame(made, "label int, fires boolean, reason string")


@query("transform_by_columns", _with(V, *_form_sql(), tail="SELECT doc_id, CAST(0 AS DOUBLE) AS gap, round(energy, 6) AS energy FROM e"))
def transform_by_columns(spark, d):
    """The linear transform by array expressions: its squared length, and the largest gap to the kernel, to six digits."""
    w = whitening.Whitening()
    t = w.get(w.fit(base(spark, d)))
    matrix = F.array(*[F.array(*map(F.lit, map(float, row))) for row in t.matrix])
    mean = F.array(*map(F.lit, map(float, t.mean)))
    by_columns = base(spark, d).select("doc_id", vec.affine(matrix, "x", mean).alias("a"))
    gap = F.array_max(F.zip_with("a", "x", lambda a, b: F.abs(a - b)))
    return by_columns.join(t.apply(base(spark, d)), "doc_id").select("doc_id", F.round(gap, 6).alias("gap"), F.round(vec.norm2("a"), 6).alias("energy"))


@query("retarget", _with(V, *_form_sql("list_transform(x, lambda z, i: z * i)"), tail="SELECT doc_id, CAST(0 AS DOUBLE) AS gap, round(energy, 4) AS energy FROM e"))
def retarget(spark, d):
    """Rows taken from one version's space to another's are where the other version puts them."""
    w, rows = whitening.Whitening(), base(spark, d)
    a, b = w.get(w.fit(rows)), w.get(w.fit(rows.withColumn("x", F.transform("x", lambda v, i: v.cast("double") * (i + 1)))))
    moved = whitening.retarget(a.apply(rows), a, b).select("doc_id", F.col("x").alias("y"))
    gap = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    return b.apply(rows).join(moved, "doc_id").select("doc_id", F.round(gap, 5).alias("gap"), F.round(vec.norm2("y"), 4).alias("energy"))


@query("hits_and_misses", _with(V, Q, E, C, A, P, S, T, _HIT, tail="SELECT query_id, doc_id, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS kind FROM h"))
def hits_and_misses(spark, d):
    """Truth rows that a search found (semi-join) and those it missed (anti-join)."""
    truth, found = _truth_and_found(spark, d)
    keys = ["query_id", "doc_id"]
    hit = truth.join(found, keys, "left_semi").select(*keys, F.lit("hit").alias("kind"))
    return hit.unionAll(truth.join(found, keys, "left_anti").select(*keys, F.lit("miss").alias("kind")))


@query("partial_update", _with(V, C, A, Z, R, N, "s AS (SELECT m, sum(err) AS e, sum(energy) AS g FROM n GROUP BY m)", tail=f"SELECT CAST(m AS INTEGER) AS m, row_number() OVER (ORDER BY e / (g + 1e-6) DESC, m) <= {M // 4} AS moved FROM s"))
def partial_update(spark, d):
    """Which subspaces an update by the worst quarter of them moves."""
    model = pq_model(spark, d)
    added = mutate.batch_sums(base(spark, d), model)
    state = mutate.OnlineState(np.full((M, WORDS), 10))
    z, _, _ = mutate.update_codebooks(model, state, added, None, mutate.OnlineConfig(top_alpha=0.25))
    moved = np.abs(z - model.codebooks).sum(axis=(1, 2)) > 0
    return spark.createDataFrame([(m, bool(moved[m])) for m in range(M)], "m int, moved boolean")


_WORDS_MOVED = M * WORDS // 4


@query("partial_update_words", _with(V, C, A, Z, R, N, f"""g AS (SELECT n.m, n.k, j, sum(r[j] - z[j]) AS s FROM n JOIN r USING (doc_id, m) JOIN z ON z.m = n.m AND z.k = n.k, range(1, {_W + 1}) AS b(j) GROUP BY n.m, n.k, j),
  h AS (SELECT m, k, sum(s * s) AS weight FROM g GROUP BY m, k)""", tail=f"SELECT CAST(z.m AS INTEGER) AS m, CAST(z.k AS INTEGER) AS k, weight IS NOT NULL AND row_number() OVER (ORDER BY weight DESC NULLS LAST, z.m, z.k) <= {_WORDS_MOVED} AS moved FROM z LEFT JOIN h ON h.m = z.m AND h.k = z.k"))
def partial_update_words(spark, d):
    """Which codewords an update of the quarter with the largest summed error moves."""
    model = pq_model(spark, d)
    added = mutate.batch_sums(base(spark, d), model)
    state = mutate.OnlineState(np.full((M, WORDS), 10))
    z, _, _ = mutate.update_codebooks(model, state, added, None, mutate.OnlineConfig(top_lambda=0.25))
    moved = np.abs(z - model.codebooks).sum(axis=2) > 0
    return spark.createDataFrame([(m, k, bool(moved[m, k])) for m in range(M) for k in range(WORDS)], "m int, k int, moved boolean")


@query("online_add", _with(V, C, A, Z, R, N, tail="SELECT n.doc_id, n.list_id, list(CAST(k AS VARCHAR) ORDER BY m)::VARCHAR AS code FROM n JOIN v USING (doc_id) WHERE label <> 2 GROUP BY n.doc_id, n.list_id"))
def online_add(spark, d):
    """Labels 5 to 9 added to an index of the others in one step with the deletion of label 2, codebooks as they are."""
    model = pq_model(spark, d)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"), "label")
    held = ivf.postings_of(ivf.encode(rows.where("label < 5").select("doc_id", "x"), model))
    state = mutate.OnlineState(np.full((M, WORDS), 10))
    out, _, _, _ = mutate.online_add(held, rows.where("label >= 5").select("doc_id", "x"), model, state, mutate.OnlineConfig(), expired=rows.where("label = 2").select("doc_id"), vectors=rows)
    return out.select("doc_id", "list_id", _code_text())


def _code_text():
    return F.concat(F.lit("["), F.array_join(F.col("code").cast("array<string>"), ", "), F.lit("]")).alias("code")


@query("saved_index", _with(V, C, A, Z, R, N, tail="SELECT doc_id, list_id, list(CAST(k AS VARCHAR) ORDER BY m)::VARCHAR AS code FROM n GROUP BY doc_id, list_id"))
def saved_index(spark, d):
    """An index written and read again: its postings, and new codes by the model that was read."""
    model = pq_model(spark, d)
    path = f"{durable_dir(spark)}/saved-{uuid.uuid4().hex}"
    artifacts.save_index(path, model, postings(spark, d, model))
    read, held, _ = artifacts.load_index(spark, path)
    again = ivf.encode(base(spark, d), read).select("doc_id", "list_id", "code")
    return held.join(again, ["doc_id", "list_id", "code"]).select("doc_id", "list_id", _code_text())


# --- whole runs ----------------------------------------------------------


@query("stream_run")
def stream_run(spark, d):
    """Main on the first rows, the others streamed in batches with freezes and merges; one row a snapshot."""
    return harness.stream_demo(spark, base(spark, d), query_rows(spark, d))


@query("workload_run")
def workload_run(spark, d):
    """Four inserts of a quarter each, a search after each."""
    return harness.workload_demo(spark, base(spark, d), query_rows(spark, d))


@query("workload_sizes", _with(V, "o AS (SELECT i, (SELECT count(*) FROM v) * (i + 1) // 4 AS seen FROM range(1, 4) AS r(i))", tail="SELECT 'search ' || (2 * i + 1) AS kind, CAST(seen AS INTEGER) AS seen, CAST(seen AS INTEGER) AS searchable FROM o"))
def workload_sizes(spark, d):
    """Of every search of ``workload_run`` but the first, which is warm-up: rows seen, and rows in shards or waiting for one."""
    runs = workload_run(spark, d)
    return runs.select("kind", "seen", (F.col("main_rows") + F.col("frozen_rows") + F.col("active_rows") + F.col("pending_rows")).alias("searchable"))


@query("service_run")
def service_run(spark, d):
    """Queries, inserts and merges at the same time; recall of each query batch by the version it saw."""
    rows = durable(base(spark, d), "raw")
    settings = harness.demo_settings(rows.count(), concurrent_workload_enable=True, concurrent_query_workers=2)
    service = concurrent.Service(harness.Engine(spark, rows, query_rows(spark, d), settings)).run(rows.count())
    return service.recall("completed").groupBy("version").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))


@query("stream_ingest", _with(V, C, A, tail="SELECT doc_id, list_id FROM a"))
def stream_ingest(spark, d):
    """Structured Streaming: every file of vectors is assigned and published exactly once."""
    return ingest.ingest_demo(spark, f"{d}/embeddings.parquet", flat_model(spark, d)).select("doc_id", "list_id")


