"""Runs over a stream of rows: consolidated and recent shards, freezes, merges, rebuilds, and evaluation on the way.

Row order is time.  The driver holds models and counters; vectors and postings
are durable tables.  A row is in no shard between a freeze and the next
training window and is then left out of searches and of the ground truth; when
the window is full, all waiting rows enter the new shard.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, Unavailable
from ..operators import exact, ivf, merge, metrics, mutate, routes
from ..operators.whitening import Whitening
from ..sources import artifacts
from ..sources.settings import Settings
from ..sources.workload import insert_range
from .durable import durable


@dataclass
class Shard:
    """One index with its online state."""

    name: str
    model: ivf.IvfModel
    postings: DataFrame
    state: mutate.OnlineState
    rows: int
    last: mutate.OnlineReport | None = None
    #: Of a flat index: postings with their vectors beside them, laid out by list.
    scan: DataFrame | None = None

    def route(self, settings: Settings) -> routes.Route:
        budget = {"main": settings.main_exact_rerank_candidates, "active": settings.active_exact_rerank_candidates, "frozen": settings.frozen_exact_rerank_candidates}[self.name]
        return routes.Route(self.name, self.model, self.postings if self.scan is None else self.scan, 0 if self.name == "main" else 1, budget)


@dataclass
class Engine:
    """Main, frozen and active shards over a table of raw vectors (doc_id dense from 0, x)."""

    spark: SparkSession
    raw: DataFrame
    queries: DataFrame
    settings: Settings
    whitening: Whitening = field(default_factory=Whitening)
    main: Shard | None = None
    frozen: Shard | None = None
    active: Shard | None = None
    pending: tuple[int, int] | None = None
    seen: int = 0
    events: list[dict] = field(default_factory=list)
    snapshots: list[dict] = field(default_factory=list)
    rebuilds: int = 0
    rebuilt_main_rows: int = 0
    rebuilt_seen: int = 0
    backpressure: int = 0
    version: int = 1
    #: Truth of a loaded final state.
    saved_truth: DataFrame | None = None
    _reuse: ivf.IvfModel | None = None

    def __post_init__(self) -> None:
        self.whitening.cosine = self.settings.use_cosine
        if self.settings.max_queries:
            self.queries = self.queries.orderBy("query_id").limit(self.settings.max_queries)
        self.vectors, self.q = self.raw, self.queries

    # --- spaces ---

    def fit_space(self, rows: int) -> None:
        """Fit the transform on the first rows and take vectors and queries to its space."""
        if self.settings.use_whitening:
            t = self.whitening.get(self.whitening.fit(self.raw.where(F.col("doc_id") < rows)))
            self.vectors = durable(t.apply(self.raw.select("doc_id", "x")), "space")
            self.q = durable(t.apply(self.queries.select("query_id", "q"), "q"), "queries")

    def rows(self, begin: int, end: int) -> DataFrame:
        return self.vectors.where((F.col("doc_id") >= begin) & (F.col("doc_id") < end)).select("doc_id", "x")

    def _train(self, rows: DataFrame, name: str, nlist: int, iterations: int) -> Shard:
        s = self.settings
        model = ivf.train(rows, nlist, s.pq_m if s.pq_enable else 0, s.pq_nbits, iterations, s.pq_residual, version=self.version)
        return self._filled(name, model, rows)

    def _filled(self, name: str, model: ivf.IvfModel, rows: DataFrame) -> Shard:
        encoded = durable(ivf.encode(rows, model), f"{name}-encoded", by="list_id")
        counts, baseline = np.zeros((0, 0), np.int64), None
        if model.is_pq:
            counts = np.zeros(model.codebooks.shape[:2], np.int64)
            for r in ivf.code_counts(encoded, model).collect():
                counts[r["m"], r["k"]] = r["n"]
            baseline = ivf.nqe_baseline(encoded).first()["nqe"]
        return Shard(name, model, ivf.postings_of(encoded, name), mutate.OnlineState(counts, baseline=baseline, ema=baseline or 0.0), encoded.count())

    # --- life of the shards ---

    def bootstrap(self, main_rows: int) -> None:
        """The consolidated index on the first rows, and an active one on the next training window."""
        self.fit_space(main_rows)
        self.main = self._train(self.rows(0, main_rows), "main", self.settings.ivf_nlist, ivf.MAIN_ITERATIONS)
        self.seen = self.rebuilt_main_rows = main_rows

    def adopt(self, model: ivf.IvfModel, postings: DataFrame, space: Whitening | None, vectors: DataFrame | None = None) -> None:
        """Start from a saved consolidated index instead of training one; ``vectors`` are rows in its space, if they were saved too."""
        if space is not None:
            self.whitening = space
            t = space.get(max(space.versions))
            self.vectors = durable(t.apply(self.raw.select("doc_id", "x")), "space") if vectors is None else vectors
            self.q = durable(t.apply(self.queries.select("query_id", "q"), "q"), "queries")
        elif vectors is not None:
            self.vectors = vectors
        n = postings.count()
        self.main = Shard("main", model, postings, mutate.OnlineState(np.zeros(model.codebooks.shape[:2] if model.is_pq else (0, 0), np.int64)), n)
        self.seen = self.rebuilt_main_rows = n

    def save_final(self, path: str) -> None:
        """All shards as they are, with their truth: what ``load_final`` starts from."""
        main, *rest = self.shards()
        s = self.settings
        live_only = s.online_pq_update_scheme == "sliding_window"
        artifacts.save_final_state(path, main.model, main.postings, self.truth(), self.seen, self.vectors if s.final_state_cache_store_vectors else None, {x.name: (x.model, x.postings) for x in rest}, self.whitening if s.use_whitening else None, live_only, topk=s.topk, queries=self.q.count())

    def load_final(self, path: str) -> None:
        """The end of an earlier run, ready to be searched; refused if it was made for other rows, queries or another topk."""
        s = self.settings
        model, postings, truth, vectors = artifacts.load_final_state(self.spark, path, dim=s.dim, topk=s.topk, queries=self.queries.count(), rows=self.raw.count(), whitening=s.use_whitening)
        self.adopt(model, postings, artifacts.load_whitening(self.spark, f"{path}/whitening") if s.use_whitening else None, vectors)
        for name, (m, p) in artifacts.load_recent(self.spark, path).items():
            counts = np.zeros(m.codebooks.shape[:2] if m.is_pq else (0, 0), np.int64)
            setattr(self, name, Shard(name, m, p, mutate.OnlineState(counts), p.count()))
        self.seen, self.saved_truth = self.raw.count(), truth

    def ingest(self, end: int) -> None:
        """Rows up to ``end``: into the active shard, or waiting for the next one."""
        begin, self.seen = self.seen, max(self.seen, end)
        if end <= begin:
            return
        if self.active is None:
            self.pending = (self.pending[0] if self.pending else begin, end)
            self.activate()
            return
        s, a = self.settings, self.active
        batch = self.rows(begin, end)
        expired, kept = None, None
        if s.online_pq_update_scheme == "sliding_window":
            order = a.postings.select("doc_id", F.col("doc_id").alias("insert_seq"))
            unit = "batches" if s.online_pq_sliding_window_use_batches else "rows"
            expired, kept = mutate.window_expired(order, end - begin, s.online_pq_sliding_window_size, unit, s.batch_rows()), self.vectors
        out, model, state, report = mutate.online_add(a.postings, batch, a.model, a.state, s.online, "active", expired=expired, vectors=kept)
        self.active = Shard("active", model, durable(out, "active"), state, a.rows + report.rows - report.deleted, report)

    def activate(self, final: bool = False) -> None:
        """A new active shard as soon as a training window waits; all waiting rows enter it."""
        if self.pending is None:
            return
        begin, end = self.pending
        if end - begin < self.settings.train_rows() and not final:
            return
        rows = self.rows(begin, end)
        if self._reuse is not None:
            model, _ = mutate.start_from(self._reuse, self.version)
            self.active = self._filled("active", model, rows)
        else:
            self.active = self._train(rows, "active", self.settings.delta_ivf_nlist or self.settings.ivf_nlist, ivf.DELTA_ITERATIONS)
        self.pending = None
        self._log("activate", rows=end - begin)

    def merge_decision(self):
        a = self.active
        if a is None:
            return self.settings.merge_trigger(self.settings.train_rows()).decide(0, self.main.rows)
        report = a.last or mutate.OnlineReport(0, 0.0, 1.0, 0.0, False)
        ratio = metrics.imbalance(ivf.partition_sizes(a.postings, a.model.nlist), "nonempty").first()["imbalance"]
        return self.settings.merge_trigger(self.settings.train_rows()).decide(a.rows, self.main.rows, report.ratio, report.drift, ratio)

    def freeze(self, reason: str) -> None:
        """The active shard stops growing; a frozen one that is still there is merged first."""
        if self.active is None:
            raise FailedPrecondition("nothing to freeze")
        if self.frozen is not None:
            self.backpressure += 1
            self.commit_merge("backpressure")
        if self.settings.online_pq_update_scheme == "minibatch" and self.active.model.is_pq and self.active.model.residual:
            self._reuse = self.active.model
        self.frozen, self.active = replace(self.active, name="frozen", postings=self.active.postings.withColumn("shard", F.lit("frozen"))), None
        self._log("freeze", reason=reason, rows=self.frozen.rows)

    def commit_merge(self, reason: str) -> merge.MergeReport | None:
        if self.frozen is None:
            return None
        return self.finish_merge(self.prepare_merge(), reason)

    def prepare_merge(self) -> tuple[merge.PreparedMerge, float]:
        """The patch that brings the frozen shard into main; changes nothing, so it needs no lock."""
        began = time.perf_counter()
        main, frozen = self.main, self.frozen
        prepared = merge.prepare(main.postings, frozen.postings, self.vectors, main.model, self.settings.merge, main.state.generation)
        return prepared, time.perf_counter() - began

    def finish_merge(self, ready: tuple[merge.PreparedMerge, float], reason: str) -> merge.MergeReport:
        """Commits a patch to the main shard as it is now; refused if that is not the one it was prepared for."""
        prepared, seconds = ready
        began, main = time.perf_counter(), self.main
        out, report = merge.commit(prepared, main.postings, main.model, main.state.generation)
        state = replace(main.state, generation=main.state.generation + 1)
        self.main = Shard("main", main.model, durable(out, "main", by="list_id"), state, main.rows + report.rows)
        self.frozen, self.version = None, self.version + 1
        self._log("merge", reason=reason, seconds=seconds + time.perf_counter() - began, **vars(report))
        return report

    def maybe_rebuild(self) -> bool:
        if not self.settings.enable_global_rebuild:
            return False
        ratio = metrics.imbalance(ivf.partition_sizes(self.main.postings, self.main.model.nlist), "nonempty").first()["imbalance"]
        decision = self.settings.rebuild_trigger.decide(self.main.rows - self.rebuilt_main_rows, ratio, self.rebuilds, self.seen, self.rebuilt_seen)
        if decision.fires:
            self.rebuild(decision.reason)
        return decision.fires

    def rebuild(self, reason: str, refit: bool = True, tail: bool = True) -> None:
        """Retrain on all seen rows; the last training window seeds a new active shard.

        Without ``refit`` the space stays, without ``tail`` all rows go to main:
        so a service rebuilds while queries go on.  The generation moves on, so
        a merge prepared before is refused.
        """
        generation = self.main.state.generation + 1
        keep = self.seen - (self.settings.train_rows() if tail else 0)
        if keep <= 0:
            raise FailedPrecondition("too few rows for a rebuild")
        if refit:
            self.fit_space(self.seen)
        self.version += 1
        self.frozen, self.active, self.pending, self._reuse = None, None, None, None
        self.main = self._train(self.rows(0, keep), "main", self.settings.ivf_nlist, ivf.MAIN_ITERATIONS)
        self.main.state = replace(self.main.state, generation=generation)
        if tail:
            self.pending = (keep, self.seen)
            self.activate()
        self.rebuilds, self.rebuilt_main_rows, self.rebuilt_seen = self.rebuilds + 1, self.main.rows, self.seen
        self._log("rebuild", reason=reason, rows=keep)

    def retrained(self, shard: Shard) -> Shard:
        """A new index of a shard's rows, in the space there is; changes nothing."""
        rows = durable(self.vectors.join(shard.postings.select("doc_id"), "doc_id", "left_semi").select("doc_id", "x"), "rebuild-rows")
        fresh = self._train(rows, shard.name, self.settings.ivf_nlist, ivf.MAIN_ITERATIONS)
        return replace(fresh, state=replace(fresh.state, generation=shard.state.generation + 1))

    def replace_main(self, old: Shard, fresh: Shard, reason: str) -> None:
        """Swap main for an index that was built from it, if it still is the same."""
        if self.main is not old:
            raise Unavailable("main changed since the rebuild began")
        self.main, self.version, self._reuse = fresh, self.version + 1, None
        self.rebuilds, self.rebuilt_main_rows, self.rebuilt_seen = self.rebuilds + 1, fresh.rows, self.seen
        self._log("rebuild", reason=reason, rows=fresh.rows)

    # --- evaluation ---

    def shards(self) -> list[Shard]:
        """The shards that hold rows; of a flat index their scans are made here, once a change."""
        out = [x for x in (self.main, self.frozen, self.active) if x is not None]
        for x in out:
            if not x.model.is_pq and x.scan is None:
                x.scan = durable(ivf.with_vectors(x.postings, self.vectors), f"{x.name}-scan", by="list_id")
        return out

    def search(self, k: int | None = None, nprobe: int | None = None) -> DataFrame:
        s = self.settings
        return routes.search([x.route(s) for x in self.shards()], self.vectors, self.q, k or s.topk, nprobe or s.nprobe, s.exact_rerank_enable, s.exact_rerank_candidates_per_route)

    def truth(self, k: int | None = None) -> DataFrame:
        ids = routes.searchable_ids([x.route(self.settings) for x in self.shards()])
        return exact.exact_topk(self.vectors, self.q, k or self.settings.topk, ids=ids)

    def evaluate(self, kind: str = "snapshot", new_begin: int = 0) -> dict:
        began = time.perf_counter()
        found = durable(self.search(), "found")
        seconds = time.perf_counter() - began
        row = {"kind": kind, "seen": self.seen, "version": self.version, "main_rows": self.main.rows, "frozen_rows": self.frozen.rows if self.frozen else 0, "active_rows": self.active.rows if self.active else 0, "pending_rows": self.pending[1] - self.pending[0] if self.pending else 0, "recall": None, "recall_new": None, "recall_old": None}
        if self.settings.enable_dynamic_ground_truth and not self.settings.skip_query_ground_truth:
            truth = durable(self.truth(), "truth")
            row["recall"] = metrics.mean_recall(truth, found, self.settings.topk).first()["recall"]
            age = metrics.age_recall(truth, found, new_begin, self.seen).first()
            row |= {"recall_new": age["recall_new"], "recall_old": age["recall_old"]}
        row["qps"] = metrics.throughput(self.q.count(), seconds)
        self.snapshots.append(row)
        return row

    def sweep(self) -> DataFrame:
        """nprobe, recall, seconds on the present state, with one ground truth."""
        truth = durable(self.truth(), "truth") if self.saved_truth is None else self.saved_truth
        rows = []
        for n in self.settings.nprobe_sweep:
            began = time.perf_counter()
            recall = metrics.mean_recall(truth, self.search(nprobe=n), self.settings.topk).first()["recall"]
            rows.append((n, recall, time.perf_counter() - began))
        return self.spark.createDataFrame(rows, "nprobe int, recall double, seconds double")

    def _log(self, kind: str, **facts) -> None:
        self.events.append({"kind": kind, "seen": self.seen, "version": self.version, **facts})

    # --- runs ---

    def step(self, end: int, last: bool) -> None:
        """One batch, then whatever it sets off."""
        self.ingest(end)
        decision = self.merge_decision()
        if self.frozen is not None and (last or decision.fires):
            self.commit_merge("end_of_stream" if last else decision.reason)
        if decision.fires and not last:
            self.freeze(decision.reason)
        self.maybe_rebuild()

    def run(self, total: int | None = None) -> Engine:
        """The whole stream: bootstrap, batches, snapshots, and a final evaluation."""
        total = self.raw.count() if total is None else total
        if self.main is None:
            self.bootstrap(self.settings.main_rows(total))
        begin = self.seen
        self.evaluate("initial", begin)
        size, snapshot = self.settings.batch_rows(), self.settings.snapshot_interval
        since = 0
        while self.seen < total:
            end = min(total, self.seen + size)
            if snapshot:
                end = min(end, begin + (since // snapshot + 1) * snapshot)
            since += end - self.seen
            self.step(end, end == total)
            if snapshot and since % snapshot == 0 and end < total:
                self.evaluate("snapshot", begin)
        self.activate(final=True)
        self.evaluate("final", begin)
        return self

    def replay(self, ops: list[dict], bootstrap_rows: int) -> Engine:
        """A log of inserts and searches.

        Nothing is indexed before ``bootstrap_rows`` rows are there, and
        searches until then count as warm-up; a freeze is merged at once.
        """
        waiting = 0
        for op in ops:
            if op["operation"] == "search":
                if self.main is None:
                    self._log("warm_up", op_id=op["op_id"])
                else:
                    self.evaluate(f"search {op['op_id']}", bootstrap_rows)
                continue
            span = insert_range(op["start"], op["end"], waiting if self.main is None else self.seen)
            if span is None:
                continue
            if self.main is None:
                waiting = span[1]
                if waiting < bootstrap_rows:
                    continue
                self.bootstrap(bootstrap_rows)
            while self.seen < span[1]:
                self.ingest(min(span[1], self.seen + self.settings.batch_rows()))
                decision = self.merge_decision()
                if decision.fires:
                    self.freeze(decision.reason)
                    self.commit_merge(decision.reason)
            self.maybe_rebuild()
        return self


_SNAPSHOT = "kind string, seen int, version int, main_rows int, frozen_rows int, active_rows int, pending_rows int, recall double, recall_new double, recall_old double, qps double"


def snapshot_table(engine: Engine) -> DataFrame:
    names = [x.split()[0] for x in _SNAPSHOT.split(", ")]
    return engine.spark.createDataFrame([tuple(s[n] for n in names) for s in engine.snapshots], _SNAPSHOT)


def demo_settings(rows: int, **changes) -> Settings:
    batch = max(1, -(-rows // 10))
    options = {"ivf_nlist": 8, "delta_ivf_nlist": 4, "topk": 10, "nprobe": 8, "use_whitening": True, "pq_enable": True, "pq_m": 16, "pq_nbits": 6, "exact_rerank_enable": True, "exact_rerank_candidates_per_route": 200, "enable_streaming": True, "streaming_mode": "batch", "stream_batch_size": batch, "main_index_rows": rows - 4 * batch, "merge_trigger_rows": batch + 1, "online_pq_force_update_interval": 1, "merge_assignment_gamma": 1.2}
    return Settings(**(options | changes)).validate()


def stream_demo(spark: SparkSession, base: DataFrame, queries: DataFrame) -> DataFrame:
    rows = durable(base, "raw")
    return snapshot_table(Engine(spark, rows, queries, demo_settings(rows.count())).run())


def workload_demo(spark: SparkSession, base: DataFrame, queries: DataFrame) -> DataFrame:
    rows = durable(base, "raw")
    n = rows.count()
    ops = []
    for i in range(4):
        ops += [{"op_id": 2 * i, "operation": "insert", "start": n * i // 4, "end": n * (i + 1) // 4}, {"op_id": 2 * i + 1, "operation": "search"}]
    return snapshot_table(Engine(spark, rows, queries, demo_settings(n)).replay(ops, n // 2))
