"""Queries, inserts and maintenance at the same time, on snapshots instead of locks.

The published state is one immutable object; a query takes it once and is
judged by the version it saw and by the version at its completion.  The lock is
held to swap states, never for the work: the one inserter alone changes the
active shard and builds its next state beside it, the one maintainer alone
changes main and prepares merges and rebuilds off the lock.  A patch commits
only on the generation it was prepared from.  While a frozen shard is being
merged and the active one is full, the inserter waits, and the wait is counted.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FailedPrecondition
from ..operators import exact, ivf, metrics, routes
from ..sources import artifacts
from .durable import durable
from .harness import Engine


@dataclass(frozen=True)
class Snapshot:
    """What a query sees: routes, and how many batches are committed."""

    version: int
    rows: int
    routes: tuple[routes.Route, ...]


@dataclass
class Service:
    """An engine behind a published snapshot."""

    engine: Engine
    records: list[tuple] = field(default_factory=list)
    batches: list[tuple] = field(default_factory=list)
    waits: int = 0
    _published: Snapshot | None = None
    #: Called while a merge is being prepared, off the lock.
    during_merge: Callable[[], None] | None = None
    _change: threading.Condition = field(default_factory=threading.Condition)
    _failed: bool = False
    _began: float = 0.0

    def publish(self, version: int) -> None:
        e = self.engine
        self._published = Snapshot(version, e.seen, tuple(s.route(e.settings) for s in e.shards()))

    @property
    def now(self) -> float:
        return (time.perf_counter() - self._began) * 1000

    def query(self, number: int, rows: DataFrame) -> None:
        """One query batch against one snapshot; rows go to ``records``."""
        e, s = self.engine, self._published
        began = self.now
        found = routes.search(list(s.routes), e.vectors, rows, e.settings.topk, e.settings.nprobe, e.settings.exact_rerank_enable, e.settings.exact_rerank_candidates_per_route).select("query_id", "doc_id", "rank").collect()
        ended = self.now
        by_query: dict[int, list] = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            by_query.setdefault(r["query_id"], []).append(r["doc_id"])
        for query_id, docs in by_query.items():
            self.records.append((number, query_id, s.version, self._published.version, ended - began, ended, docs))

    def insert_all(self, total: int) -> None:
        """Batch after batch; freezes and merges where they are due."""
        e, size, version = self.engine, self.engine.settings.batch_rows(), 0
        rate = e.settings.concurrent_target_insert_vecps
        first = e.seen
        while e.seen < total:
            if rate > 0:
                time.sleep(max(0.0, (e.seen - first) / rate - self.now / 1000))
            began, begin_row = self.now, e.seen
            e.ingest(min(total, e.seen + size))
            decision = e.merge_decision()
            with self._change:
                if decision.fires:
                    if e.frozen is not None:
                        self.waits += 1
                        e.backpressure += 1
                        self._change.wait_for(lambda: e.frozen is None or self._failed)
                    if self._failed:
                        return
                    e.freeze(decision.reason)
                    self._change.notify_all()
                version += 1
                self.publish(version)
            self.batches.append((version, version, begin_row, e.seen, began, self.now))

    def maintain(self, stop: threading.Event) -> None:
        """Merges frozen shards until told to stop, once more at the end; rebuilds where that is due."""
        try:
            while True:
                last = stop.is_set()
                if self.engine.frozen is not None:
                    ready = self.engine.prepare_merge()
                    if self.during_merge is not None:
                        self.during_merge()
                    with self._change:
                        self.engine.finish_merge(ready, "maintenance")
                        self.publish(self._published.version)
                        self._change.notify_all()
                    self.maybe_rebuild()
                if last:
                    return
                stop.wait(0.05)
        except BaseException:
            with self._change:
                self._failed = True
                self._change.notify_all()
            raise

    def maybe_rebuild(self) -> bool:
        """A new main index of the rows that main holds, trained off the lock in the space there is; recent shards stay as they are."""
        e = self.engine
        if not e.settings.enable_global_rebuild:
            return False
        old = e.main
        ratio = metrics.imbalance(ivf.partition_sizes(old.postings, old.model.nlist), "nonempty").first()["imbalance"]
        decision = e.settings.rebuild_trigger.decide(old.rows - e.rebuilt_main_rows, ratio, e.rebuilds, e.seen, e.rebuilt_seen)
        if not decision.fires:
            return False
        fresh = e.retrained(old)
        with self._change:
            e.replace_main(old, fresh, decision.reason)
            self.publish(self._published.version)
        return True

    def start(self, total: int) -> None:
        """Main on the first rows: trained, or as an earlier run prepared it."""
        e, s = self.engine, self.engine.settings
        rows = s.main_rows(total)
        if s.concurrent_init_mode == "load":
            main, space, _ = artifacts.load_init(e.spark, s.concurrent_init_path, dim=s.dim, main_rows=rows, whitening=s.use_whitening)
            e.adopt(*main, space)
            return
        e.bootstrap(rows)
        if s.concurrent_init_mode == "prepare":
            artifacts.save_init(s.concurrent_init_path, (e.main.model, e.main.postings), e.whitening if s.use_whitening else None, main_rows=rows)

    def run(self, total: int, query_rounds: int = 2) -> Service:
        """The whole stream with ``query_workers`` threads asking meanwhile."""
        e = self.engine
        self.start(total)
        self.publish(0)
        self._began = time.perf_counter()
        stop = threading.Event()
        with ThreadPoolExecutor(2 + e.settings.concurrent_query_workers) as pool:
            maintenance = pool.submit(self.maintain, stop)
            inserts = pool.submit(self.insert_all, total)
            asked = [pool.submit(self.query, i, e.q) for i in range(query_rounds * e.settings.concurrent_query_workers)]
            for job in [inserts, *asked]:
                job.result()
            stop.set()
            maintenance.result()
        e.activate(final=True)
        self.publish(self._published.version)
        self.query(len(asked), e.q)
        return self

    # --- tables ---

    def record_table(self) -> DataFrame:
        """number, query_id, version (seen), completed (version at completion), latency_ms, completion_ms, doc_ids."""
        return self.engine.spark.createDataFrame(self.records, "number int, query_id long, version int, completed int, latency_ms double, completion_ms double, doc_ids array<long>")

    def batch_table(self) -> DataFrame:
        return self.engine.spark.createDataFrame(self.batches, "batch int, version int, begin_row long, end_row long, start_ms double, end_ms double")

    def truth(self) -> DataFrame:
        """version, frontier, query_id, rank, doc_id: exact truth of every committed version, searched or as an earlier run prepared it."""
        e, s = self.engine, self.engine.settings
        first = self.batches[0][2] if self.batches else e.seen
        frontiers = {0: first} | {b[1]: b[3] for b in self.batches}
        facts = {"queries": e.q.count(), "k": s.topk, "initial": first, "batch": s.batch_rows()}
        if s.concurrent_gt_mode == "load":
            top = artifacts.load_truth(e.spark, s.concurrent_gt_path, **facts)
            if missing := set(frontiers.values()) - {r[0] for r in top.select("frontier").distinct().collect()}:
                raise FailedPrecondition(f"no truth at {min(missing)} rows in {s.concurrent_gt_path}")
        else:
            top = exact.frontier_topk(e.vectors, e.q, s.topk, list(frontiers.values()))
        versions = e.spark.createDataFrame([(v, f) for v, f in frontiers.items()], "version int, frontier int")
        out = durable(top.join(F.broadcast(versions), "frontier").select("version", "frontier", "query_id", "rank", "doc_id"), "truth")
        if s.concurrent_gt_mode == "prepare":
            artifacts.save_truth(s.concurrent_gt_path, out, **facts)
        return out

    def recall(self, at: str = "version", truth: DataFrame | None = None) -> DataFrame:
        """query_id, version, recall by the version a query saw, or by that at its completion."""
        rows = self.record_table().select("query_id", F.col("completed" if at == "completed" else "version").alias("version"), "doc_ids")
        return metrics.as_of_recall(rows, self.truth() if truth is None else truth, self.engine.settings.topk)
