"""MinHash near-dedup by Jaccard, banding and verification.

1. Texts become sets of five-word shingles.  ProbMinHash signs them with unit
   weights: every shingle is a Poisson process of rate one, each arrival falls
   on a random register, a register keeps the shingle that arrives first, and a
   shingle stops as soon as its next arrival is later than every register's.
   Two registers agree with the Jaccard of the two sets, the same that links
   are verified by, however often a text repeats a passage.
2. Texts with the same words are one node.  Signatures are cut into bands;
   nodes that share a band are candidates.
3. Within a band's bucket every node is compared with one leader only: the node
   whose buckets are the fullest, which in a group of copies is the one nearest
   to all others.  Links are verified by the exact Jaccard of the shingle sets,
   and joined into components.
4. Buckets that still hold more than one component are compared in blocks,
   inside a kernel, only between different components and in the first bucket
   that two nodes share; every such pair whose sizes allow the threshold is
   verified there, on its shingle sets, and only links that join two components
   come out.  No bucket is capped.
5. Comparing all blocks of a bucket costs the square of its size, so the nodes
   of a bucket of more than ``WIDE`` are first dealt to finer ones, without loss:
   a set's shingles are ordered by the number of such nodes that hold them, and
   two sets of the threshold's Jaccard must share one among the rarest
   n - ceil(threshold * n) + 1 of each.  Pages of one template, which share many
   shingles but not their rare ones, then never meet.
6. A document's class is the least doc_id of its component.

Edge cases: null texts, and texts without words, link with nothing but their
exact copies (a null text with none); texts of fewer than five words have one
shingle of all their words; repeated rows come out as often as they came in,
in one class; rows are told apart by id and text, so an id that stands on
several texts, or a null id, is no tie between them; a class of rows without
any id has a null class_id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._native import durable, pinned
from ._words import U, Words, mix, parts, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
BLOCK = 256
#: Nodes of a bucket beyond which it is dealt to finer ones.
WIDE = 4 * BLOCK

_GOLD = U(0x9E3779B97F4A7C15)


def signatures(s: np.ndarray, so: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash of every text: (texts, m) shingles, and the number of distinct shingles."""
    n_docs = len(so) - 1
    doc = np.repeat(np.arange(n_docs, dtype=U), np.diff(so))
    keys = np.unique((doc << U(48)) | (s >> U(16)))
    doc = (keys >> U(48)).astype(np.int64)
    element = mix(keys & U((1 << 48) - 1))
    distinct = np.bincount(doc, minlength=n_docs)
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, dtype=U)
    clock = np.zeros(len(keys))
    step = 0
    with np.errstate(over="ignore"):
        while len(element):
            width = 1 if len(element) > 20_000 else 16
            x = mix(element[:, None] + np.arange(step + 1, step + 1 + width, dtype=U) * _GOLD)
            times = clock[:, None] + np.cumsum(-np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
            place = doc[:, None] * m + (((x & U(2047)) * U(m)) >> U(11)).astype(np.int64)
            np.minimum.at(first, place.ravel(), times.ravel())
            won = times == first[place]
            owner[place[won]] = np.broadcast_to(element[:, None], won.shape)[won]
            step += width
            clock = times[:, -1]
            live = clock < first.reshape(n_docs, m).max(axis=1)[doc]
            element, doc, clock = element[live], doc[live], clock[live]
    return owner.reshape(n_docs, m), distinct


def _node(key: bytes) -> int:
    return int.from_bytes(hashlib.md5(key).digest()[:8], "little", signed=True)


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in parts(batch, 1):
                h, off = words.of(part.column(1))
                s, so = shingles(h, off, SHINGLE)
                sig, distinct = signatures(s, so, m)
                with np.errstate(over="ignore"):
                    band = np.zeros((len(sig), bands), dtype=U)
                    for r in range(rows):
                        band = mix(band + sig[:, r::rows]) + _GOLD
                    band = mix(band + np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93))
                raw = part.column(1)
                nodes = []
                for i in range(len(part)):
                    if off[i + 1] > off[i]:
                        key = h[off[i] : off[i + 1]].tobytes()
                    else:
                        key = b"\0" + (raw[i].as_py() or "").encode()
                    nodes.append(_node(key))
                full = distinct > 0
                lists = np.where(full, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(2),
                        pa.array(nodes, pa.int64(), mask=np.array(raw.is_null())),
                        pa.array(distinct, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(band[full].ravel().view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "node", "n", "bands"],
                )

    return run


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, node (one per sequence of words; null for a null text), n distinct shingles, band keys."""
    return _hashed(docs).mapInArrow(_sign(bands, rows), "doc_id long, text_hash long, node long, n int, bands array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return pinned(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node) to (node, sorted shingles) where the text is the node's."""
    words = Words()
    for batch in batches:
        for part in parts(batch, 0):
            h, off = words.of(part.column(0))
            s, so = shingles(h, off, SHINGLE)
            node = part.column(1).to_numpy()
            own = [i for i in range(len(part)) if _node(h[off[i] : off[i + 1]].tobytes()) == node[i]]
            sets = [np.unique(s[so[i] : so[i + 1]]) for i in own]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            flat = np.concatenate([*sets, np.empty(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "s"])


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose shingle sets (node, s) have a Jaccard of the threshold or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return durable(counted.where(F.col("i") >= F.lit(threshold) * (F.col("n") - F.col("i"))).select("a", "b"), "dedup-links")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of the component, for all nodes with a link.

    Labels flow along links and then along labels, so long chains halve at
    every step; each step is a durable table and only a count reaches the driver.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-both")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        closer = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        over = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        moved = durable(closer.join(over, "next").select("node", F.least("next", "beyond").alias("comp"), (F.least("next", "beyond") != F.col("comp")).alias("moved")), "dedup-labels")
        if moved.where("moved").isEmpty():
            return labels
        labels = moved.select("node", "comp")


def _block_links(threshold: float, finer: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        node, comp, side, n = (table.column(c).to_numpy() for c in ("node", "comp", "side", "n"))
        lists = table.column("keys").combine_chunks()
        keys, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        even = len(set(np.diff(cuts).tolist())) == 1
        bands = keys[cuts[0] : cuts[-1]].reshape(len(node), -1) if even and not finer else None
        here = (bands == bucket).argmax(axis=1) if bands is not None else None
        sets = table.column("s").combine_chunks()
        values, ends = sets.values.to_numpy().view(U), sets.offsets.to_numpy()  # sorted as unsigned numbers
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b = [], []
        for i in left:
            other = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i]))]
            if side[i] == 2:
                other = other[node[other] > node[i]]
            if bands is not None:
                other = other[(bands[other] == bands[i]).argmax(axis=1) == here[i]]
            mine = values[ends[i] : ends[i + 1]]
            for j in other:
                p, q = find(int(comp[i])), find(int(comp[j]))
                if p == q:
                    continue
                # Rare shingles are sorted: the pair is for the bucket of the first that both have.
                if bands is None and np.intersect1d(keys[cuts[i] : cuts[i + 1]], keys[cuts[j] : cuts[j + 1]], assume_unique=True)[0] != bucket:
                    continue
                theirs = values[ends[j] : ends[j + 1]]
                shared = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
                if shared >= threshold * (int(n[i]) + int(n[j]) - shared):
                    root[q] = p
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def residual_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, finer: bool = False) -> DataFrame:
    """Links that join different components of a bucket.

    ``members`` has bucket, node and comp of all buckets with more than one
    component, ``nodes`` each node's n and keys, the buckets it may be in.  A
    bucket's largest component needs no look at itself: only its strays, the
    members of other components, meet each other and all of it.  Both are dealt
    to blocks of about ``BLOCK`` nodes and every pair of blocks that has to meet
    does so in one task, so no task holds a bucket, and one large component with
    few strays costs its size and not the square of it.
    """
    shares = members.groupBy("bucket", "comp").agg(F.count("*").alias("own"))
    tops = durable(shares.groupBy("bucket").agg(F.max(F.struct("own", "comp")).alias("top"), F.sum("own").alias("all")).select("bucket", F.col("top.comp").alias("top"), F.col("top.own").alias("main"), (F.col("all") - F.col("top.own")).alias("strays")), "dedup-tops")
    dealt = members.select("bucket", "node", "comp").join(tops, "bucket").withColumn("stray", F.col("comp") != F.col("top"))
    dealt = dealt.withColumn("blocks", F.ceil(F.col("strays") / BLOCK)).withColumn("mains", F.ceil(F.col("main") / BLOCK))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("stray"), F.col("blocks")).otherwise(F.col("mains"))))
    # Joined before rows are told to their meetings: a join's rows stay one a member.
    held = dealt.join(nodes, "node").join(sets, "node")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meeting = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))
    mine = F.col("mine")
    among = F.transform(upto(F.col("blocks")), lambda o: meeting(0, F.least(mine, o), F.greatest(mine, o), F.when(mine == o, 2).when(mine < o, 0).otherwise(1)))
    across = F.transform(upto(F.col("mains")), lambda o: meeting(1, mine, o, F.lit(0)))
    back = F.transform(upto(F.col("blocks")), lambda o: meeting(1, o, mine, F.lit(1)))
    met = held.withColumn("m", F.explode(F.when(F.col("stray"), F.concat(among, across)).otherwise(back)))
    rows = met.select("bucket", "m.kind", "m.low", "m.high", "m.side", "node", "comp", "n", "keys", "s")
    # Dealt by all four keys: left to itself Spark keeps a bucket's blocks where the join put them, in one task.
    at = ["bucket", "kind", "low", "high"]
    return rows.repartition(*at).groupBy(*at).applyInArrow(_block_links(threshold, finer), "a long, b long").distinct()


def rare_shingles(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, n, keys: of each node's shingles the rarest n - ceil(threshold * n) + 1, sorted.

    How rare a shingle is counts over ``nodes`` (node); with one order for all
    sets, any two of them with a Jaccard of the threshold share one of these.
    """
    own = durable(sets.join(nodes.select("node").distinct(), "node", "left_semi"), "dedup-wide")
    each = own.select("node", F.explode("s").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = each.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("x"))
    n = F.size("x")
    kept = F.slice("x", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    return durable(ordered.select("node", n.alias("n"), F.sort_array(F.transform(kept, lambda y: y["shingle"])).alias("keys")), "dedup-rare")


def wide_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of ``members`` (node, comp), the nodes of wide buckets."""
    ours = durable(members.select("node", "comp").distinct(), "dedup-wide-nodes")
    rare = rare_shingles(ours, sets, threshold)
    placed = rare.select("node", F.explode("keys").alias("bucket")).join(ours, "node")
    split = durable(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket", "size"), "dedup-wide-split")
    return residual_links(placed.join(split, "bucket"), rare, sets, threshold, finer=True)


def _named(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, text_hash and node; and of every node its class: class_id, and doc_id and text_hash of the row that stands for the class."""
    signed = durable(sign(docs, bands, rows), "dedup-signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = durable(signed.where("node is not null").groupBy("node").agg(F.min(row).alias("least"), F.first(F.struct("n", "bands")).alias("x")).select("node", "least", "x.n", "x.bands"), "dedup-nodes")

    in_bucket = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = durable(in_bucket.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "dedup-buckets")
    members = durable(in_bucket.join(sizes, "bucket"), "dedup-members")
    hubs = members.groupBy("node").agg(F.sum("size").alias("hub"))
    best = members.join(hubs, "node").groupBy("bucket").agg(F.max(F.struct("hub", F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("d")).select("bucket", "d.leader", "d.leader_n")
    likely = F.least("n", "leader_n") >= F.lit(threshold) * F.greatest("n", "leader_n")
    stars = durable(members.join(best, "bucket").where(F.col("node") != F.col("leader")).where(likely).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "dedup-stars")

    # The text of one row stands for its node: found again by its id and hash.
    ours = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("own_id"), F.col("least.text_hash").alias("own_hash"))
    texts = _hashed(docs).join(ours, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).select("text", "node")
    sets = durable(texts.mapInArrow(_own_sets, "node long, s array<long>").dropDuplicates(["node"]), "dedup-sets")
    links = verify(stars, sets, threshold)
    comp = components(links)

    placed = members.join(comp, "node", "left").select("bucket", "size", "node", F.coalesce("comp", "node").alias("comp"))
    # A table of its own, so that the join below is of two scans and Spark can split a hot bucket.
    split = durable(placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket"), "dedup-split")
    rest = durable(placed.join(split, "bucket"), "dedup-rest")
    more = durable(residual_links(rest.where(F.col("size") <= WIDE), nodes.select("node", "n", F.col("bands").alias("keys")), sets, threshold), "dedup-more-links")
    wide = rest.where(F.col("size") > WIDE)
    if not wide.isEmpty():
        more = more.union(durable(wide_links(wide, sets, threshold), "dedup-wide-links"))
    if not more.isEmpty():
        comp = components(links.union(more))

    label = durable(nodes.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "dedup-comp")
    first = durable(label.groupBy("comp").agg(F.min("least").alias("first")), "dedup-first")
    return signed.select("doc_id", "text_hash", "node"), label.join(first, "comp").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("class_hash"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id of every row: near copies share the least doc_id of their class."""
    signed, named = _named(docs, threshold, bands, rows)
    return signed.join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of ``docs``: that of its least doc_id, of several texts with that id the one of least hash.

    Rows with a null text are classes of their own and all stay.  A null id is
    after all others.  Of rows with the same id and text one stays.
    """
    _, named = _named(docs, threshold, BANDS, ROWS)
    key = ["__id", "__none", "__hash"]
    keyed = lambda df, i, h: df.withColumn("__id", F.coalesce(i, F.lit(0))).withColumn("__none", i.isNull()).withColumn("__hash", h)
    kept = durable(keyed(named, F.col("class_id"), F.col("class_hash")).select(*key).distinct(), "dedup-kept")
    # Join and duplicates go by the same columns: texts are shuffled once.
    rows = keyed(docs.where(F.col("text").isNotNull()), F.col("doc_id"), F.xxhash64("text"))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col("text").isNull()))
