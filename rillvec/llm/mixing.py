"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by the MD5 of their id and text) and laid
end to end, twice if the source may repeat; a document's virtual finish time is
the tokens of its source up to and including it, divided by the source's target.
All copies are range-sorted by that time and the order is cut at the budget.

Prefix sums are distributed: rows go to slices of the hash (or of virtual
time), slice totals give offsets, and only within a slice rows are summed in
order.  A slice has at most about ``ROWS_PER_SLICE`` rows, and fewer where the
table would not fill ``SLICES`` of them.  A source of any size is spread over
all slices, so no task holds a whole source.  Rows of one id, text and source
are counted first and take one place in the order; they are told out again in
chunks of ``CHUNK``, so one row that is repeated without end fills no task.
What meets in one task is one row a source, and one row a slice (a slice of
20,000 documents is one row there).

Edge cases: a null or empty text has size 0 and is never worth taking; a null
source is a source of its own, last in order; a table without words has zero
targets and takes nothing; equal ids and equal times are ordered by size, and
rows that are equal in all of these take the same; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._native import WORD, durable, pinned, text_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
ROWS_PER_SLICE = 20_000
SLICES = 512
CHUNK = 10_000


def slices_for(rows: int) -> int:
    return max(1, rows // ROWS_PER_SLICE, min(SLICES, rows // 200))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the shuffling key."""
    size = F.regexp_count(text_of("text"), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), text_of("text")).cast("binary"))
    return pinned(docs, "doc_id", "source", "text").select("doc_id", "source", size.alias("size"), key.alias("key"))


def targets(by_source: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``repeats`` times its source.

    The level at which all weights are served is a fixed point over sources;
    each step sends two sums to the driver.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.alias("weight"))
    cap = repeats * F.col("source_size")
    whole, level, stopped = None, 0.0, -1
    while True:
        full = cap < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        whole = row[0] or 0
        if row[3] == stopped or not row[2]:
            break
        stopped, level = row[3], (budget * whole - row[1]) / row[2]
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _running(rows: DataFrame, slice_of: Column, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``through``: the sum of ``load`` up to and including a row, within its group."""
    cut = rows.withColumn("slice", slice_of)
    keys = [*group, "slice"]
    before = W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(F.sum("load").alias("in_slice")).select(*keys, F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("offset"))
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = cut.withColumn("within", F.sum("load").over(inner)).join(offsets.select(*[F.col(k).alias(f"o_{k}") for k in keys], "offset"), [cut[k].eqNullSafe(F.col(f"o_{k}")) for k in keys])
    return joined.withColumn("through", F.col("offset") + F.col("within")).drop(*[f"o_{k}" for k in keys], "offset", "within", "slice")


def told_out(lined: DataFrame) -> DataFrame:
    """Rows with a count ``n`` as n rows, each with its own ``through``."""
    chunks = lined.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    if (lined.agg(F.max("n")).first()[0] or 0) > CHUNK:
        chunks = chunks.repartition("key", "first")
    each = chunks.withColumn("j", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("first") + CHUNK, F.col("n")))))
    return each.withColumn("through", F.col("through") - (F.col("n") - F.col("j")) * F.col("size")).drop("n", "first", "j", "load")


def mix(docs: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    base = durable(sizes(docs), "mix-sizes")
    goal = durable(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), budget, repeats, weights), "mix-targets")
    rows = base.count()
    slices = slices_for(rows)
    by_hash = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("int")
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    counted = base.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")).withColumn("load", F.col("size") * F.col("n"))
    lined = told_out(durable(_running(counted, by_hash, ["source"], order), "mix-order"))
    lined = durable(lined.join(F.broadcast(goal.select(F.col("source").alias("s"), "source_size", "target")) if goal.count() <= 10_000 else goal.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-lined")
    finish = lambda lap: F.when(F.col("target") > 0, (F.col("through") + lap * F.col("source_size")) / F.col("target"))
    copies = lined.where("size > 0 and target > 0").withColumn("lap", F.explode(F.array(*map(F.lit, range(repeats))))).select(finish(F.col("lap")).alias("time"), "source", "key", "doc_id", F.col("size").alias("load"), "size").where("time <= 1.0 + 1e-9")
    spread = slices_for(rows * repeats)
    timed = _running(copies, F.floor(F.least(F.col("time"), F.lit(1.0)) * spread).cast("int"), [], [F.col("time"), F.col("source").asc_nulls_last(), *order])
    last = timed.where(F.col("through") <= F.lit(budget) * F.lit(goal.agg(F.sum("source_size")).first()[0] or 0)).agg(F.max("time")).first()[0]
    cut = F.lit(last).cast("double")
    laps = sum((F.when(finish(F.lit(lap)) <= cut, 1).otherwise(0) for lap in range(repeats)), F.lit(0))
    return lined.select("doc_id", "size", "source_size", "target", (F.col("size") * laps).cast("long").alias("taken"))
