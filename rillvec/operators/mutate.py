"""Changes to an index: checked adds and deletes, online codebook updates, sliding windows, optimistic commits."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, Unavailable
from ..plans.reduce import PARTIAL, collect_sums, partial
from ..plans.shared import share
from .exact import matrix
from .ivf import IvfModel, encode, encode_rows, nearest, postings_of


# --- validation ----------------------------------------------------------


def insert_faults(batch: DataFrame, postings: DataFrame, dim: int) -> DataFrame:
    """doc_id, fault of rows that make a batch invalid: wrong dim, an id twice in it, an id already held."""
    bad_dim = batch.where(F.size("x") != dim).select("doc_id", F.lit("dim").alias("fault"))
    twice = batch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate").alias("fault"))
    held = batch.select("doc_id").join(postings.select("doc_id"), "doc_id", "left_semi").distinct().select("doc_id", F.lit("present").alias("fault"))
    return bad_dim.unionAll(twice).unionAll(held)


def delete_faults(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, fault: an id twice in the request, or one that is not held."""
    twice = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate").alias("fault"))
    unknown = ids.select("doc_id").join(postings.select("doc_id"), "doc_id", "left_anti").distinct().select("doc_id", F.lit("unknown").alias("fault"))
    return twice.unionAll(unknown)


def _refuse(faults: DataFrame) -> None:
    first = faults.orderBy("fault", "doc_id").first()
    if first is None:
        return
    kind = {"present": AlreadyExists, "unknown": NotFound}.get(first["fault"], InvalidArgument)
    raise kind(f"{first['fault']}: doc_id {first['doc_id']}")


def add(postings: DataFrame, batch: DataFrame, model: IvfModel, shard: str = "main", lists: DataFrame | None = None) -> DataFrame:
    """Postings with the batch appended, all of it or nothing."""
    _refuse(insert_faults(batch, postings, model.dim))
    return postings.unionByName(postings_of(encode(batch, model, lists), shard))


def delete(postings: DataFrame, ids: DataFrame) -> DataFrame:
    _refuse(delete_faults(ids, postings))
    return postings.join(ids.select("doc_id"), "doc_id", "left_anti").select(*postings.columns)


def empty_postings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "shard string, list_id int, doc_id long, code array<short>")


# --- online product quantization -----------------------------------------


@dataclass(frozen=True)
class OnlineConfig:
    enable: bool = True
    interval: int = 0
    ema_alpha: float = 0.1
    eps: float = 1e-6
    warmup_batches: int = 0
    top_alpha: float | None = None
    top_lambda: float | None = None
    reencode_batch: bool = True


@dataclass(frozen=True)
class OnlineState:
    """What persists between batches; ``counts`` is (m, words)."""

    counts: np.ndarray
    batch_no: int = 0
    warmup_sum: float = 0.0
    warmup_seen: int = 0
    baseline: float | None = None
    ema: float = 0.0
    generation: int = 0
    stale_codes: bool = False

    def ratio(self, eps: float = 1e-6) -> float:
        return self.ema / max(eps, self.baseline) if self.baseline is not None else 1.0


@dataclass(frozen=True)
class BatchSums:
    """Per subspace and word: rows, sum of sub-vectors, sum of errors; per subspace error and energy; the sum of rows' error ratios."""

    n: np.ndarray
    total: np.ndarray
    err: np.ndarray
    sub_err: np.ndarray
    sub_energy: np.ndarray
    ratio_sum: float
    rows: int

    @property
    def nqe(self) -> float:
        return self.ratio_sum / self.rows if self.rows else 0.0

    def __add__(self, other: BatchSums) -> BatchSums:
        return BatchSums(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    def packed(self) -> np.ndarray:
        """One row a word: n, sum, error sum; then one a subspace: error, energy; then one: ratio sum, rows."""
        m, words, width = self.total.shape
        out = np.zeros((m * words + m + 1, 1 + 2 * width))
        out[: m * words] = np.concatenate([self.n[:, :, None], self.total, self.err], axis=2).reshape(m * words, -1)
        out[m * words : -1, :2] = np.stack([self.sub_err, self.sub_energy], axis=1)
        out[-1, :2] = self.ratio_sum, self.rows
        return out

    @classmethod
    def unpacked(cls, x: np.ndarray, model: IvfModel) -> BatchSums:
        m, words, width = model.codebooks.shape
        word = x[: m * words].reshape(m, words, -1)
        return cls(np.rint(word[:, :, 0]).astype(np.int64), word[:, :, 1 : 1 + width], word[:, :, 1 + width :], x[m * words : -1, 0], x[m * words : -1, 1], float(x[-1, 0]), int(round(x[-1, 1])))

    @classmethod
    def zero(cls, model: IvfModel) -> BatchSums:
        m, words, _ = model.codebooks.shape
        return cls(np.zeros((m, words), np.int64), np.zeros(model.codebooks.shape), np.zeros(model.codebooks.shape), np.zeros(m), np.zeros(m), 0.0, 0)


def sums(x: np.ndarray, lists: np.ndarray, codes: np.ndarray | None, model: IvfModel, eps: float = 1e-6) -> BatchSums:
    """Sums of rows under their given codes, or under fresh ones."""
    book = model.codebooks
    m, words, width = book.shape
    fresh, err, energy = encode_rows(x, lists, model)
    r = x - model.centroids[lists] if model.residual else x
    codes = fresh if codes is None else codes
    n, total, errs = np.zeros((m, words), np.int64), np.zeros(book.shape), np.zeros(book.shape)
    for j in range(m):
        sub = r[:, j * width : (j + 1) * width]
        n[j] = np.bincount(codes[:, j], minlength=words)
        np.add.at(total[j], codes[:, j], sub)
        np.add.at(errs[j], codes[:, j], sub - book[j][codes[:, j]])
    return BatchSums(n, total, errs, err.sum(axis=0), energy.sum(axis=0), float((err.sum(axis=1) / (energy.sum(axis=1) + eps)).sum()), len(x))


def _sum_kernel(shared, coded: bool, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: IvfModel = shared.value
        out = BatchSums.zero(model)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                lists = batch.column(1).to_numpy().astype(np.int64) if coded else nearest(x, model.centroids)[0]
                out = out + sums(x, lists, matrix(batch.column(2)).astype(np.int64) if coded else None, model, eps)
        yield partial(out.packed())

    return run


def batch_sums(rows: DataFrame, model: IvfModel, eps: float = 1e-6, coded: bool = False) -> BatchSums:
    """Sums over a DataFrame of x, and of list_id and code if ``coded``: tasks' sums are added on executors, one row a word reaches the driver."""
    shared = share(rows.sparkSession, model)
    parts = rows.select(*(["x", "list_id", "code"] if coded else ["x"])).mapInArrow(_sum_kernel(shared, coded, eps), PARTIAL)
    m, words, width = model.codebooks.shape
    return BatchSums.unpacked(collect_sums(parts, m * words + m + 1, 1 + 2 * width), model)


def top_fraction(ratio: float, total: int) -> int:
    return min(total, max(1, math.ceil(ratio * total))) if total else 0


def update_codebooks(model: IvfModel, state: OnlineState, added: BatchSums, removed: BatchSums | None, config: OnlineConfig) -> tuple[np.ndarray, np.ndarray, float]:
    """New codebooks, new counts, and the drift: the exact running mean of each touched codeword.

    A word keeps its place if nothing is left under it.  ``top_alpha`` limits
    the update to the worst share of subspaces, ``top_lambda`` to the share of
    words with the largest error sums.
    """
    n_del = removed.n if removed is not None else np.zeros_like(added.n)
    s_del = removed.total if removed is not None else np.zeros_like(added.total)
    n_new = np.maximum(0, state.counts + added.n - n_del)
    touched = (added.n + n_del) > 0
    if config.top_alpha is not None:
        ratio = added.sub_err / (added.sub_energy + config.eps)
        keep = np.argsort(-ratio, kind="stable")[: top_fraction(config.top_alpha, len(ratio))]
        touched &= np.isin(np.arange(len(ratio)), keep)[:, None]
    if config.top_lambda is not None:
        weight = (added.err**2).sum(axis=2) + ((removed.err**2).sum(axis=2) if removed is not None else 0.0)
        order = np.argsort(-np.where(touched, weight, -1.0).ravel(), kind="stable")
        mask = np.zeros(weight.size, dtype=bool)
        mask[order[: min(int(touched.sum()), top_fraction(config.top_lambda, weight.size))]] = True
        touched &= mask.reshape(weight.shape)
    moved = touched & (n_new > 0)
    z = np.where(moved[:, :, None], (state.counts[:, :, None] * model.codebooks + added.total - s_del) / np.maximum(n_new, 1)[:, :, None], model.codebooks)
    return z, n_new, float(np.sqrt(((z - model.codebooks) ** 2).sum()))


def error_state(state: OnlineState, nqe: float, config: OnlineConfig) -> OnlineState:
    """Batch number and error tracking: warm-up batches set the baseline, later ones the moving average."""
    state = replace(state, batch_no=state.batch_no + 1)
    if state.warmup_seen < config.warmup_batches:
        total, seen = state.warmup_sum + nqe, state.warmup_seen + 1
        return replace(state, warmup_sum=total, warmup_seen=seen, baseline=total / seen, ema=total / seen)
    if state.baseline is None:
        return replace(state, baseline=nqe, ema=nqe)
    return replace(state, ema=config.ema_alpha * nqe + (1 - config.ema_alpha) * state.ema)


def may_update(state: OnlineState, config: OnlineConfig, skip_once: bool = False) -> bool:
    """Codebooks move on every ``interval``-th batch, never in warm-up; an interval of 0 means never."""
    return config.enable and config.interval > 0 and state.batch_no % config.interval == 0 and not skip_once and state.batch_no > config.warmup_batches


@dataclass(frozen=True)
class OnlineReport:
    rows: int
    nqe: float
    ratio: float
    drift: float
    updated: bool
    deleted: int = 0


def online_add(postings: DataFrame, batch: DataFrame, model: IvfModel, state: OnlineState, config: OnlineConfig, shard: str = "active", skip_once: bool = False, expired: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, IvfModel, OnlineState, OnlineReport]:
    """Add a mini-batch, and with ``expired`` (doc_id) delete in the same step.

    The batch is encoded with the old codebooks; then codebooks may move by the
    exact running mean of what came and, where ``vectors`` still has it, of
    what went.  Only this batch is encoded again, so older codes go stale.  An
    index without residual PQ only adds and deletes.
    """
    _refuse(insert_faults(batch, postings, model.dim))
    kept = postings if expired is None else delete(postings, expired)
    gone = 0 if expired is None else expired.count()
    if not model.is_pq or not model.residual:
        out = kept.unionByName(postings_of(encode(batch, model), shard))
        return out, model, replace(state, batch_no=state.batch_no + 1, generation=state.generation + 1), OnlineReport(batch.count(), 0.0, 1.0, 0.0, False, gone)
    added = batch_sums(batch, model, config.eps)
    removed = None
    if expired is not None and vectors is not None and gone:
        coded = postings.join(expired.select("doc_id"), "doc_id").join(vectors.select("doc_id", "x"), "doc_id")
        removed = batch_sums(coded, model, config.eps, coded=True)
    state = error_state(state, added.nqe, config)
    n_new = np.maximum(0, state.counts + added.n - (removed.n if removed is not None else 0))
    drift, updated, changed = 0.0, may_update(state, config, skip_once), model
    if updated:
        z, n_new, drift = update_codebooks(model, state, added, removed, config)
        changed = replace(model, codebooks=z)
    coded_with = changed if updated and config.reencode_batch else model
    out = kept.unionByName(postings_of(encode(batch, coded_with), shard))
    state = replace(state, counts=n_new, generation=state.generation + 1, stale_codes=state.stale_codes or (updated and drift > 0))
    return out, changed, state, OnlineReport(added.rows, added.nqe, state.ratio(config.eps), drift, updated, gone)


def window_expired(order: DataFrame, incoming: int, size: int, unit: str = "rows", batch_rows: int = 1) -> DataFrame:
    """doc_id of the oldest rows (doc_id, insert_seq) that a window of ``size`` rows or batches must drop for ``incoming`` new ones."""
    if unit not in ("rows", "batches"):
        raise InvalidArgument("unit must be rows or batches")
    limit = size * batch_rows if unit == "batches" else size
    drop = max(0, order.count() + incoming - limit)
    return order.orderBy("insert_seq", "doc_id").limit(drop).select("doc_id")


# --- optimistic commits --------------------------------------------------


@dataclass
class IndexHandle:
    """The published state; a commit succeeds only on the generation it was prepared from."""

    postings: DataFrame
    model: IvfModel
    state: OnlineState
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def prepare(self, batch: DataFrame, config: OnlineConfig, **kwargs) -> Prepared:
        postings, model, state = self.postings, self.model, self.state
        return Prepared(state.generation, model.centroids.shape, *online_add(postings, batch, model, state, config, **kwargs))

    def commit(self, prepared: Prepared) -> OnlineReport:
        with self._lock:
            if prepared.generation != self.state.generation or prepared.shape != self.model.centroids.shape:
                raise Unavailable("the index changed since the batch was prepared")
            self.postings, self.model, self.state = prepared.postings, prepared.model, prepared.state
        return prepared.report


@dataclass(frozen=True)
class Prepared:
    generation: int
    shape: tuple[int, ...]
    postings: DataFrame
    model: IvfModel
    state: OnlineState
    report: OnlineReport


def start_from(model: IvfModel, version: int, initialised: bool = False) -> tuple[IvfModel, OnlineState]:
    """An empty index under a new version that takes over a trained model."""
    if initialised:
        raise FailedPrecondition("the index has a model already")
    counts = np.zeros(model.codebooks.shape[:2], np.int64) if model.is_pq else np.zeros((0, 0), np.int64)
    return replace(model, version=version), OnlineState(counts)
