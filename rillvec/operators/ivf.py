"""Inverted lists and product quantization: training, encoding and search.

A model (centroids, codebooks) is a small array on the driver and is broadcast
to kernels; vectors and postings are DataFrames and stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument
from ..functions.vectors import as_double, l2sq, residual, subvector
from ..plans.reduce import PARTIAL, collect_sums, partial
from ..plans.shared import share
from .exact import fast_sqdist, matrix, nearest_pairs, query_blocks, rough_sqdist, top_k

MAIN_ITERATIONS, DELTA_ITERATIONS = 20, 10
_POSTING = "list_id int, doc_id long, code array<short>"


@dataclass(frozen=True)
class IvfModel:
    """Routing centroids, and for PQ one codebook a subspace: (m, words, width)."""

    centroids: np.ndarray
    codebooks: np.ndarray | None = None
    residual: bool = True
    version: int = 1
    counts: np.ndarray | None = field(default=None, compare=False)

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @property
    def is_pq(self) -> bool:
        return self.codebooks is not None

    def centroid_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list_id int, c array<double>")

    def codebook_table(self, spark: SparkSession) -> DataFrame:
        if self.codebooks is None:
            raise FailedPrecondition("not a PQ index")
        return spark.createDataFrame([(m, k, z.tolist()) for m, book in enumerate(self.codebooks) for k, z in enumerate(book)], "m int, k int, z array<double>")


def check_pq(dim: int, m: int, nbits: int) -> None:
    if not 1 <= nbits <= 8:
        raise InvalidArgument("nbits must be 1 to 8")
    if m < 1 or dim % m:
        raise InvalidArgument(f"dim {dim} is not a multiple of m {m}")


# --- assignment ----------------------------------------------------------


def assign_columns(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """doc_id, list_id, dist of the nearest centroid (list_id, c), ties to the lower list; built-in expressions."""
    pairs = base.crossJoin(F.broadcast(centroids)).select("doc_id", "list_id", l2sq("x", "c").alias("dist"))
    best = pairs.groupBy("doc_id").agg(F.min(F.struct("dist", "list_id")).alias("b"))
    return best.select("doc_id", F.col("b.list_id").alias("list_id"), F.col("b.dist").alias("dist"))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and exact distance to, the nearest centre; of equal ones the first."""
    best = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        rows = x[at : at + 4096]
        d, off = rough_sqdist(rows, centres)
        close = d <= d.min(axis=1, keepdims=True) + 2 * off
        best[at : at + 4096] = close.argmax(axis=1)
        # Where rounding leaves several, the direct form decides.
        i, c = np.nonzero(close & (close.sum(axis=1, keepdims=True) > 1))
        if len(i):
            diff = rows[i] - centres[c]
            order = np.lexsort((c, np.einsum("ij,ij->i", diff, diff), i))
            some, first = np.unique(i[order], return_index=True)
            best[at + some] = c[order][first]
    diff = x - centres[best]
    return best, np.einsum("ij,ij->i", diff, diff)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, dist = nearest(matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(dist)], names=["doc_id", "list_id", "dist"])

    return run


def assign(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """doc_id, list_id, dist by an Arrow kernel; no shuffle."""
    shared = share(base.sparkSession, np.asarray(centroids, dtype=np.float64))
    return base.select("doc_id", "x").mapInArrow(_assign(shared), "doc_id long, list_id int, dist double")


def partition_sizes(postings: DataFrame, nlist: int) -> DataFrame:
    """list_id, n of all lists, empty ones too."""
    lists = postings.sparkSession.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    return lists.join(postings.groupBy("list_id").agg(F.count("*").alias("n")), "list_id", "left").select("list_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# --- training ------------------------------------------------------------


def initial_rows(base: DataFrame, k: int, seed: int | None = None) -> np.ndarray:
    """k rows to start from: the first by id, or by a seeded hash of the id; rows repeat if there are fewer than k."""
    order = [F.col("doc_id")] if seed is None else [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]
    rows = [r[0] for r in base.orderBy(*order).select("x").limit(k).collect()]
    if not rows:
        raise InvalidArgument("no rows to train on")
    return np.array([rows[i % len(rows)] for i in range(k)], dtype=np.float64)


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        total = np.zeros((len(centres), 1 + centres.shape[1]))
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                best, _ = nearest(x, centres)
                np.add.at(total[:, 1:], best, x)
                total[:, 0] += np.bincount(best, minlength=len(centres))
        yield partial(total)

    return run


def moved(centres: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The means of (n, sum) rows; a centre with no rows stays."""
    n = total[:, :1]
    return np.where(n > 0, total[:, 1:] / np.maximum(n, 1), centres)


def kmeans(base: DataFrame, k: int, iterations: int = MAIN_ITERATIONS, seed: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds, exactly ``iterations`` of them; an empty cluster takes a row drawn by a hash of the round.

    Each task adds up its rows per cluster, executors add the tasks' sums, and
    k rows a round reach the driver.  ``base`` should be a cached or durable table.
    """
    centres = initial_rows(base, k, seed) if start is None else np.asarray(start, dtype=np.float64).copy()
    rows = base.select("x")
    for step in range(iterations):
        shared = share(base.sparkSession, centres)
        total = collect_sums(rows.mapInArrow(_sums(shared), PARTIAL), len(centres), 1 + centres.shape[1])
        shared.unpersist()
        centres = moved(centres, total)
        empty = np.flatnonzero(total[:, 0] == 0)
        if len(empty):
            centres[empty] = initial_rows(base, len(empty), (seed or 42) + 1 + step)
    return centres


def _book_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        m, words, width = books.shape
        total = np.zeros((m * words, 1 + width))
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                r = x if centres is None else x - centres[nearest(x, centres)[0]]
                for j in range(m):
                    sub = r[:, j * width : (j + 1) * width]
                    at = nearest(sub, books[j])[0] + j * words
                    np.add.at(total[:, 1:], at, sub)
                    total[:, 0] += np.bincount(at, minlength=len(total))
        yield partial(total)

    return run


def pq_rounds(base: DataFrame, centres: np.ndarray | None, books: np.ndarray, iterations: int) -> np.ndarray:
    """Lloyd's rounds of all subspaces at once over all rows (their residuals, with centres): one pass a round."""
    m, words, width = books.shape
    for _ in range(iterations):
        shared = share(base.sparkSession, (centres, books))
        total = collect_sums(base.select("x").mapInArrow(_book_sums(shared), PARTIAL), m * words, 1 + width)
        shared.unpersist()
        books = moved(books.reshape(m * words, width), total).reshape(books.shape)
    return books


def local_kmeans(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """The same rounds on rows that are on the driver."""
    centres = x[np.arange(k) % len(x)].copy()
    for _ in range(iterations):
        best, _ = nearest(x, centres)
        total = np.zeros((k, 1 + x.shape[1]))
        np.add.at(total[:, 1:], best, x)
        total[:, 0] = np.bincount(best, minlength=k)
        centres = moved(centres, total)
    return centres


#: Rows up to which codebooks are fitted where the driver is; beyond, the same rounds run over the cluster.
LOCAL_ROWS = 65_536


def train_codebooks(base: DataFrame, centres: np.ndarray | None, m: int, nbits: int, iterations: int, sample: int | None = None) -> np.ndarray:
    """Codebooks (m, words, width) from all rows, or from ``sample`` rows by hash where a caller asks for that; residuals where centres are given."""
    ordered = base.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "x")
    rows, n = (base, base.count()) if sample is None else (ordered.limit(sample), min(sample, base.count()))
    words = 1 << nbits
    local = n <= LOCAL_ROWS
    x = np.array([r["x"] for r in ordered.limit(n if local else words).collect()], dtype=np.float64)
    if centres is not None:
        x = x - centres[nearest(x, centres)[0]]
    parts = np.split(x, m, axis=1)
    if local:
        return np.stack([local_kmeans(part, words, iterations) for part in parts])
    return pq_rounds(rows, centres, np.stack(parts), iterations)


def train(base: DataFrame, nlist: int, m: int = 0, nbits: int = 8, iterations: int = MAIN_ITERATIONS, residual: bool = True, seed: int | None = None, centroids: np.ndarray | None = None, codebooks: np.ndarray | None = None, version: int = 1, sample: int | None = None) -> IvfModel:
    """Centroids and, if m > 0, codebooks, on all rows (codebooks on a sample if one is asked for); given ones are taken as they are."""
    n = base.count()
    if n == 0:
        raise InvalidArgument("no rows to train on")
    centres = np.asarray(centroids, dtype=np.float64) if centroids is not None else kmeans(base, min(nlist, n), iterations, seed)
    if m == 0:
        return IvfModel(centres, None, residual, version)
    check_pq(centres.shape[1], m, nbits)
    if codebooks is None:
        codebooks = train_codebooks(base, centres if residual else None, m, nbits, iterations, sample)
    return IvfModel(centres, np.asarray(codebooks, dtype=np.float64), residual, version)


# --- encoding ------------------------------------------------------------


def encode_rows(x: np.ndarray, lists: np.ndarray, model: IvfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, m), and per row and subspace the error and the energy of what was coded."""
    book = model.codebooks
    r = x - model.centroids[lists] if model.residual else x
    m, _, width = book.shape
    codes, err, energy = np.empty((len(x), m), np.int64), np.empty((len(x), m)), np.empty((len(x), m))
    for j in range(m):
        sub = r[:, j * width : (j + 1) * width]
        codes[:, j], err[:, j] = nearest(sub, book[j])
        energy[:, j] = np.einsum("ij,ij->i", sub, sub)
    return codes, err, energy


def _encode(shared, keep_lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: IvfModel = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            lists = batch.column(2).to_numpy().astype(np.int64) if keep_lists else nearest(x, model.centroids)[0]
            if model.is_pq:
                codes, err, energy = encode_rows(x, lists, model)
                code = pa.array([c.tolist() for c in codes], pa.list_(pa.int16()))
                errs, energies = err.sum(axis=1), energy.sum(axis=1)
            else:
                code, errs, energies = pa.nulls(len(x), pa.list_(pa.int16())), np.zeros(len(x)), np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0), code, pa.array(errs), pa.array(energies)], names=["list_id", "doc_id", "code", "err", "energy"])

    return run


def encode(base: DataFrame, model: IvfModel, lists: DataFrame | None = None) -> DataFrame:
    """list_id, doc_id, code, err, energy of every row.

    ``lists`` (doc_id, list_id) fixes the lists, as a merge does; else each row
    goes to its nearest.  A flat index has null codes.
    """
    shared = share(base.sparkSession, model)
    rows = base.select("doc_id", "x") if lists is None else base.select("doc_id", "x").join(lists.select("doc_id", "list_id"), "doc_id").select("doc_id", "x", "list_id")
    return rows.mapInArrow(_encode(shared, lists is not None), _POSTING + ", err double, energy double")


def postings_of(encoded: DataFrame, shard: str = "main") -> DataFrame:
    return encoded.select(F.lit(shard).alias("shard"), "list_id", "doc_id", "code")


def code_counts(postings: DataFrame, model: IvfModel) -> DataFrame:
    """m, k, n: how often each codeword is used; zeros are left out."""
    return postings.select(F.posexplode("code").alias("m", "k")).groupBy("m", "k").agg(F.count("*").alias("n"))


def nqe_baseline(encoded: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: the mean over records of error / (energy + eps)."""
    return encoded.agg(F.avg(F.col("err") / (F.col("energy") + eps)).alias("nqe"), F.count("*").alias("n"))


# --- search --------------------------------------------------------------


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, nlist: int) -> DataFrame:
    """query_id, list_id, q, list_dist of the nearest lists, nprobe of them but one at least and nlist at most."""
    n = max(1, min(nprobe, nlist))
    pairs = queries.crossJoin(F.broadcast(centroids)).select("query_id", "q", "list_id", "c", l2sq("q", "c").alias("list_dist"))
    w = W.partitionBy("query_id").orderBy("list_dist", "list_id")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def probe_plans(model: IvfModel, queries: DataFrame, nprobe: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, chosen) of each block of queries; ``chosen`` (queries, lists) says which lists a query probes.

    A plan is made before anything is scanned and names the lists of one
    snapshot, so a search is a scan of planned lists, whatever is published
    meanwhile.
    """
    n = max(1, min(nprobe, model.nlist))
    for ids, q in query_blocks(queries):
        order = np.argsort(fast_sqdist(q, model.centroids), axis=1, kind="stable")[:, :n]
        chosen = np.zeros((len(q), model.nlist), dtype=bool)
        np.put_along_axis(chosen, order, True, axis=1)
        yield ids, q, chosen


def planned(postings: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The postings of lists that any query probes: on a table laid out by list only their files are read."""
    touched = np.flatnonzero(chosen.any(axis=0))
    return postings if len(touched) == chosen.shape[1] else postings.where(F.col("list_id").isin([int(x) for x in touched]))


def with_vectors(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Postings of a flat index with their vectors beside them, so that a search joins nothing."""
    return postings.drop("code").join(vectors.select("doc_id", "x"), "doc_id")


def _flat(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, chosen = shared.value
        keep: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            if not len(batch):
                continue
            lists, docs, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for list_id in np.unique(lists):
                who = np.flatnonzero(chosen[:, list_id])
                if not len(who):
                    continue
                rows = np.flatnonzero(lists == list_id)
                a, b, exact = nearest_pairs(q[who], x[rows], k)
                for out, value in zip(keep, (ids[who[a]], docs[rows[b]], np.full(len(a), list_id, np.int32), exact), strict=True):
                    out.append(value)
            if sum(map(len, keep[0])) > 200_000:
                yield _flush(keep, k, False)
                keep = [[], [], [], []]
        if keep[0]:
            yield _flush(keep, k, False)

    return run


_FOUND = "query_id long, doc_id long, list_id int, approx double"


def flat_candidates(model: IvfModel, postings: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """query_id, doc_id, list_id, approx of rows in probed lists, with exact distances; at most k rows a task and query.

    Postings that hold x are scanned as they are; others fetch it by doc_id.
    """
    spark = postings.sparkSession
    out = spark.createDataFrame([], _FOUND)
    for ids, q, chosen in probe_plans(model, queries, nprobe):
        rows = planned(postings, chosen)
        rows = rows if "x" in rows.columns else with_vectors(rows, vectors)
        out = out.unionAll(rows.select("list_id", "doc_id", "x").mapInArrow(_flat(share(spark, (ids, q, chosen)), k), _FOUND))
    return out


def search_flat(model: IvfModel, postings: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """query_id, doc_id, list_id, approx, rank: exact distances in the probed lists."""
    return top_k(flat_candidates(model, postings, vectors, queries, k, nprobe), k, ["approx", "doc_id"])


def lookup_tables(q: np.ndarray, centre: np.ndarray | None, book: np.ndarray) -> np.ndarray:
    """(queries, m, words): squared distance of each query's part, less the centre's, to each codeword."""
    r = q if centre is None else q - centre
    m, words, width = book.shape
    parts = r.reshape(len(q), m, 1, width) - book[None]
    return np.einsum("qmkd,qmkd->qmk", parts, parts)


def precomputed_tables(q: np.ndarray, centre: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same tables split in a part of the query and list, and a part of the list alone.

    ``|q - c|^2 + sum_m (|z|^2 + 2 c_m z) - 2 sum_m q_m z``: constants (queries,)
    and tables (queries, m, words).
    """
    m, _, width = book.shape
    z2 = np.einsum("mkd,mkd->mk", book, book)
    cz = np.einsum("md,mkd->mk", centre.reshape(m, width), book)
    qz = np.einsum("qmd,mkd->qmk", q.reshape(len(q), m, width), book)
    d = q - centre
    return np.einsum("qd,qd->q", d, d), (z2 + 2 * cz)[None] - 2 * qz


def _adc(shared, k: int, precomputed: bool, trace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, q, chosen = shared.value
        keep: list[list[np.ndarray]] = [[], [], [], []]
        tables: dict[int, tuple] = {}
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(0).to_numpy()
            docs = batch.column(1).to_numpy()
            codes = matrix(batch.column(2)).astype(np.int64)
            for list_id in np.unique(lists):
                who = np.flatnonzero(chosen[:, list_id])
                if not len(who):
                    continue
                rows = np.flatnonzero(lists == list_id)
                if list_id not in tables:
                    if len(tables) >= 64:
                        tables.clear()
                    centre = model.centroids[list_id] if model.residual else None
                    tables[list_id] = precomputed_tables(q[who], centre, model.codebooks) if precomputed and model.residual else (np.zeros(len(who)), lookup_tables(q[who], centre, model.codebooks))
                constant, table = tables[list_id]
                approx = constant[:, None] + np.zeros((len(who), len(rows)))
                for m in range(codes.shape[1]):
                    approx += table[:, m, :][:, codes[rows, m]]
                if not trace and len(rows) > k:
                    edge = np.partition(approx, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(approx <= edge)
                else:
                    a, b = (x.ravel() for x in np.indices(approx.shape))
                for out, value in zip(keep, (ids[who[a]], docs[rows[b]], np.full(len(a), list_id, np.int32), approx[a, b]), strict=True):
                    out.append(value)
            if sum(map(len, keep[0])) > 200_000:
                yield _flush(keep, k, trace)
                keep = [[], [], [], []]
        if keep[0]:
            yield _flush(keep, k, trace)

    return run


def _flush(keep: list[list[np.ndarray]], k: int, trace: bool) -> pa.RecordBatch:
    query, doc, lists, approx = (np.concatenate(x) for x in keep)
    if not trace:
        order = np.lexsort((doc, approx, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        query, doc, lists, approx = query[order], doc[order], lists[order], approx[order]
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(lists), pa.array(approx)], names=["query_id", "doc_id", "list_id", "approx"])


def adc_candidates(model: IvfModel, postings: DataFrame, queries: DataFrame, k: int, nprobe: int, precomputed: bool = False, trace: bool = False) -> DataFrame:
    """query_id, doc_id, list_id, approx by asymmetric distances; at most k rows a task and query unless traced.

    Postings outside all probed lists are filtered before the kernel, by list;
    each task keeps the k nearest per query, so what is shuffled does not grow
    with the lists.
    """
    if not model.is_pq:
        raise FailedPrecondition("not a PQ index")
    out = postings.sparkSession.createDataFrame([], _FOUND)
    for ids, q, chosen in probe_plans(model, queries, nprobe):
        shared = share(postings.sparkSession, (model, ids, q, chosen))
        out = out.unionAll(planned(postings, chosen).select("list_id", "doc_id", "code").mapInArrow(_adc(shared, k, precomputed, trace), _FOUND))
    return out


def search_adc(model: IvfModel, postings: DataFrame, queries: DataFrame, k: int, nprobe: int, precomputed: bool = False) -> DataFrame:
    """query_id, doc_id, list_id, approx, rank."""
    return top_k(adc_candidates(model, postings, queries, k, nprobe, precomputed), k, ["approx", "doc_id"])


def adc_columns(model: IvfModel, postings: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The same by built-in expressions: the twin that tests hold the kernel against.

    A code's terms are added in its own order, not by an aggregate, whose order
    is open: rows of one list and code tie to the last bit, and ties go by doc_id.
    """
    spark = postings.sparkSession
    probed = probes(queries, model.centroid_table(spark), nprobe, model.nlist)
    width = model.codebooks.shape[2]
    books = F.broadcast(spark.createDataFrame([(model.codebooks.tolist(),)], "books array<array<array<double>>>"))
    r = residual("q", "c") if model.residual else as_double("q")
    table = F.transform("books", lambda book, m: F.transform(book, lambda z: l2sq(subvector(F.col("r"), m, width), z)))
    tables = probed.withColumn("r", r).crossJoin(books).select("query_id", "list_id", table.alias("t"))
    coded = postings.select("list_id", "doc_id", "code").where("code is not null")
    # Term by term, for generated code: a fold would be interpreted for each pair.
    approx = reduce(add, [F.get(F.get("t", F.lit(m)), F.get("code", F.lit(m)).cast("int")) for m in range(len(model.codebooks))])
    return top_k(tables.join(coded, "list_id").select("query_id", "doc_id", "list_id", approx.alias("approx")), k, ["approx", "doc_id"])


def scanned(queries: DataFrame, centroids: DataFrame, postings: DataFrame, nprobe: int, nlist: int) -> DataFrame:
    """query_id, scanned: rows in the probed lists."""
    sizes = postings.groupBy("list_id").agg(F.count("*").alias("n"))
    return probes(queries, centroids, nprobe, nlist).select("query_id", "list_id").join(sizes, "list_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"))


@dataclass
class Searcher:
    """A single index with an optional transform before the search."""

    model: IvfModel | None = None
    postings: DataFrame | None = None
    vectors: DataFrame | None = None
    transform: object | None = None

    def set_index(self, model: IvfModel, postings: DataFrame, vectors: DataFrame) -> Searcher:
        self.model, self.postings, self.vectors = model, postings, vectors
        return self

    def set_transform(self, transform) -> Searcher:
        self.transform = transform
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """Candidates of the index; all count as new rows."""
        if self.model is None or self.postings is None:
            raise FailedPrecondition("no index is set")
        q = self.transform.apply(queries, "q") if self.transform is not None else queries
        if self.model.is_pq:
            found = search_adc(self.model, self.postings, q, k, nprobe).drop("list_id")
        else:
            found = search_flat(self.model, self.postings, self.vectors, q, k, nprobe).drop("list_id")
        return found.withColumn("from_new", F.lit(1))


def with_version(model: IvfModel, version: int) -> IvfModel:
    return replace(model, version=version)


# --- introspection -------------------------------------------------------


def doc_ids(postings: DataFrame) -> DataFrame:
    return postings.select("doc_id")


def code_of(postings: DataFrame, doc_id: int) -> DataFrame:
    """list_id and code of one document."""
    return postings.where(F.col("doc_id") == doc_id).select("list_id", "code")


def records(postings: DataFrame, vectors: DataFrame, model: IvfModel, list_id: int | None = None) -> DataFrame:
    """list_id, doc_id, x of a flat index, or of one of its lists; codes alone can't give vectors back."""
    if model.is_pq:
        raise FailedPrecondition("a PQ index holds codes, not vectors")
    rows = postings if list_id is None else postings.where(F.col("list_id") == list_id)
    return rows.select("list_id", "doc_id").join(vectors.select("doc_id", "x"), "doc_id")
