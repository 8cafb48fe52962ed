"""Benchmark decontamination by size-partitioned MinHash containment search.

Items fall in size partitions by their number of five-word shingles (powers of
two).  For a partition of sizes up to S, every document is covered by windows
of 2S shingles that start every S shingles, so a stretch of up to S shingles
lies wholly in one window, however long the document.  An item that a window
contains to the threshold has a Jaccard similarity with it that is bounded
from below, and each partition takes as many MinHash bands as that bound needs
for a miss rate of ``MISS``.

The search has two sides.  Items are few bytes each but their number is not
bounded, so what is broadcast is two bitmaps of fixed size: band keys of items,
and shingles of items.  A document with a window whose band key is in the first
comes out with those keys and with its own shingles that are in the second: a
superset of all it shares with any item.  Equi-joins on the keys then give
(document, item) pairs, and the intersection of the two shingle sets gives the
exact containment.  A fuller bitmap passes more rows to the join and loses none.

Edge cases: null and empty texts, and items of fewer than five words, have no
five-word shingle and match nothing; repeated rows of documents come out as
often as they came in, items with one id are judged text by text; an empty
table on either side gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillvec.plans.shared import share

from ._native import durable, pinned
from ._words import U, Words, mix, parts, shingles

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-4
#: Bits of each bitmap.
BITS = 1 << 23

_GOLD = U(0x9E3779B97F4A7C15)


def bands_for(top: int, threshold: float, miss: float = MISS) -> int:
    """Bands of one row for the partition of sizes (top / 2, top] to miss a match with probability ``miss``."""
    least = top // 2 + 1
    jaccard = threshold * least / (least + 2 * top - threshold * least)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def partition_of(n: np.ndarray) -> np.ndarray:
    """log2 of the partition's greatest size."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _minhash(s: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (s ^ (U(j + 1) * _GOLD)) * U((2 * j + 3) * 0x9E3779B1 * 0x85EBCA77 & 0xFFFFFFFFFFFFFFFF | 1)


def _band_key(low: np.ndarray, level: int, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(low + U(level * 4096 + j + 1) * _GOLD)


def _items(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in parts(batch, 1):
                h, off = words.of(part.column(1))
                s, so = shingles(h, off, SHINGLE)
                ids, levels, sets, keys = [], [], [], []
                for i, item in enumerate(part.column(0).to_pylist()):
                    if off[i + 1] - off[i] < SHINGLE:
                        continue
                    own = np.unique(s[so[i] : so[i + 1]])
                    level = int(partition_of(np.array([len(own)]))[0])
                    low = np.array([_minhash(own, j).min() for j in range(bands_for(1 << level, threshold, miss))], dtype=U)
                    ids.append(item)
                    levels.append(level)
                    sets.append(own.view(np.int64))
                    keys.append(np.array([_band_key(low[j : j + 1], level, j)[0] for j in range(len(low))], dtype=U).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "level", "shingles", "keys"])

    return run


def index_items(items: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """item_id, level, shingles, keys of every item of five words or more."""
    return pinned(items, "item_id", "text").mapInArrow(_items(threshold, miss), "item_id long, level int, shingles array<long>, keys array<long>")


def _place(x: np.ndarray, bits: int) -> np.ndarray:
    return x & U(bits - 1)


def _search(levels: list[int], threshold: float, miss: float, key_bits, shingle_bits, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        in_keys = np.unpackbits(np.frombuffer(key_bits.value, dtype=np.uint8)).astype(bool)
        in_shingles = np.unpackbits(np.frombuffer(shingle_bits.value, dtype=np.uint8)).astype(bool)
        finest = min(levels)
        most = {level: bands_for(1 << level, threshold, miss) for level in levels}
        for batch in batches:
            for part in parts(batch, 1):
                h, off = words.of(part.column(1))
                if not len(h):
                    continue
                s, so = shingles(h, off, SHINGLE)
                # Chunks of the smallest partition's size; they never cross a document.
                n = np.diff(so)
                chunks = -(-n // (1 << finest))
                co = np.concatenate([[0], np.cumsum(chunks)])
                owner = np.repeat(np.arange(len(n)), chunks)
                starts = so[owner] + (np.arange(co[-1]) - co[owner]) * (1 << finest)
                hit_doc, hit_key = [], []
                if not len(starts):
                    continue
                for j in range(max(most.values())):
                    low, own = np.minimum.reduceat(_minhash(s, j), starts), owner
                    place = np.arange(co[-1]) - co[owner]
                    for level in range(finest, max(levels) + 1):
                        if level > finest:
                            even = np.flatnonzero(place % 2 == 0)
                            low, own, place = np.minimum.reduceat(low, even), own[even], place[even] // 2
                        if level in most and j < most[level]:
                            near = np.full(len(low), np.iinfo(np.uint64).max, dtype=U)
                            pair = own[:-1] == own[1:]
                            near[:-1][pair] = low[1:][pair]
                            key = _band_key(np.minimum(low, near), level, j)
                            hit = np.flatnonzero(in_keys[_place(key, bits)])
                            if len(hit):
                                hit_doc.append(own[hit])
                                hit_key.append(key[hit])
                if not hit_doc:
                    continue
                doc, key = np.concatenate(hit_doc), np.concatenate(hit_key)
                rows, keys, sets = [], [], []
                for i in np.unique(doc):
                    own = s[so[i] : so[i + 1]]
                    own = np.unique(own[in_shingles[_place(own, bits)]])
                    if len(own):
                        rows.append(int(i))
                        keys.append(np.unique(key[doc == i]).view(np.int64))
                        sets.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "keys", "found"])

    return run


_HIT = "doc_id long, text_hash long, keys array<long>, found array<long>"
_PAIR = "doc_id long, text_hash long, item_id long, n_shared int, n_item int, containment double"


def _pairs(docs: DataFrame, items: DataFrame, threshold: float, miss: float, bits: int) -> DataFrame:
    """The pairs of ``contaminated``, with the hash of the document's text."""
    spark = docs.sparkSession
    index = durable(index_items(items, threshold, miss), "bench-index")
    levels = sorted(r[0] for r in index.select("level").distinct().collect())
    if not levels:
        return spark.createDataFrame([], _PAIR)
    packed = [share(spark, np.packbits(_bits(index.select(F.explode(c).alias("x")), bits)).tobytes()) for c in ("keys", "shingles")]
    texts = pinned(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text"))
    hits = durable(texts.mapInArrow(_search(levels, threshold, miss, *packed, bits), _HIT).withColumn("row", F.monotonically_increasing_id()), "bench-hits")
    sets = index.select("item_id", F.xxhash64("shingles").alias("print"), "shingles", "keys")
    pairs = hits.select("row", F.explode("keys").alias("key")).join(sets.select("item_id", "print", F.explode("keys").alias("key")), "key").select("row", "item_id", "print").distinct()
    own = sets.select(F.col("item_id").alias("item"), F.col("print").alias("p"), "shingles").dropDuplicates(["item", "p"])
    both = pairs.join(hits.select("row", "doc_id", "text_hash", "found"), "row").join(own, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("print") == F.col("p")))
    shared, size = F.size(F.array_intersect("found", "shingles")), F.size("shingles")
    return both.select("doc_id", "text_hash", "item_id", shared.alias("n_shared"), size.alias("n_item"), (shared / size).alias("containment")).where(F.col("containment") >= threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, bits: int = BITS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of all pairs with a containment of the threshold or more."""
    return _pairs(docs, items, threshold, miss, bits).drop("text_hash")


def _bits(values: DataFrame, bits: int) -> np.ndarray:
    """One bool a bit: is there a value that leaves it modulo ``bits``?  Spark builds pieces of 4 KB, at most bits / 32768 of them."""
    place = F.pmod(F.col("x"), F.lit(bits))
    rows = values.groupBy(F.floor(place / (1 << 15)).alias("b")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("m")).collect()
    out = np.zeros(bits, dtype=bool)
    for row in rows:
        out[row["b"] << 15 : (row["b"] + 1) << 15] = np.unpackbits(np.frombuffer(bytes(row["m"]), dtype=np.uint8), bitorder="little")
    return out


def remove(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with all their columns; rows without an id, or with an id that others share, are told apart by their text."""
    # A table of its own: where it is small the planner, which then knows its size, does not shuffle the texts.
    bad = durable(_pairs(docs, items, threshold, MISS, BITS).select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash")).distinct(), "bench-bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")
