"""Cross-entropy difference of a target and a background n-gram model.

Both models are bigram models of words (full 64-bit word hashes, 0 is the
start of a text) with the same vocabulary, the same smoothing and the same
prior: p(w|h) = (c(hw) + K p(w)) / (c(h) + K), p(w) = (c(w) + 1/2) / (N + V/2).
A row's own occurrences are left out of the background's counts c (not of its
size N), so a text is not its own evidence, and one that occurs twice shows.
V is the number of distinct words of both corpora, counted exactly, and never
less than ``CLASSES``: a small corpus leaves room for words not seen.
The background is the whole corpus to be scored, the target any other table of
texts.  A document's score is the mean over its tokens of the target's loss
minus the background's, in bits: low means more like the target.

Neither word nor bigram counts are gathered anywhere.  A token's loss is
log2(c(h) + K) - log2(c(hw) + K p(w)); the second part needs counts of w and of
bigrams that end in w, the first is summed with the word h itself, once for
every time that a word follows it.  So each block of documents sends its
bigrams, packed by document, to the partition that owns their last word; the
partition counts all blocks' words and bigrams and answers with each document's
part of the two sums.  The number of partitions follows the number of tokens.
A few very frequent words and bigrams (at most 1 / ``HOT`` of each) would make
one partition large; they are counted exactly in an earlier pass.  Such bigrams
are scored where the document is, other bigrams that end in such a word are
dealt by both their words.  Which ones count as frequent is read off a sample:
that chooses the route of a bigram and never changes a count or a score.

Edge cases: null and empty texts, or texts without words, have no tokens and
null losses; rows that repeat a doc_id are scored together, one row comes out;
an empty corpus gives an empty result, an empty target leaves the prior alone;
extra columns are ignored; long texts are a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillvec.plans.shared import share

from ._native import pinned
from ._words import U, Words, mix, parts

#: The least vocabulary that the prior leaves room for.
CLASSES = 1 << 16
KAPPA = 8.0
HOT = 1 / 20_000
#: Documents on which frequent bigrams are looked for: one of so many, by hash.
HOT_SAMPLE = 32
TOKENS_PER_PARTITION = 2_000_000
#: A partition holds 2 million tokens up to 2e12 tokens (some 10 TB), and 20 million (about half a GB) at ten times that.
MOST_PARTITIONS = 1 << 20
BLOCK_BYTES = 1 << 22

START, END = U(0), U(0xFFFFFFFFFFFFFFFF)

_COUNTS = "kind int, key long, target long, background long"
_CELL = "part int, block long, is_target boolean, words binary, runs binary, keys binary, counts binary, places binary, docs binary, local binary, own binary"
_SUMS = "block long, docs binary, sums binary"


def tokens(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word, the word before it (``START`` at a text's first), the index of its text, and whether it is the text's last."""
    h, off = words.of(texts)
    w = np.clip(h, U(1), END - U(1))
    history = np.empty_like(w)
    history[1:] = w[:-1]
    n = np.diff(off)
    history[off[:-1][n > 0]] = START
    last = np.zeros(len(w), dtype=bool)
    last[off[1:][n > 0] - 1] = True
    return w, history, np.repeat(np.arange(len(n)), n), last


def pair(history: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit key of a bigram."""
    with np.errstate(over="ignore"):
        return mix(history * U(0x9E3779B97F4A7C15) + w)


def place_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ``known`` ones, and where."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in parts(batch, 0, BLOCK_BYTES):
            w, history, _, _ = tokens(words, part.column(0))
            one, n_one = np.unique(w, return_counts=True)
            _, first, n_two = np.unique(pair(history, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(one), END), history[first]]).view(np.int64)), pa.array(np.concatenate([one, w[first]]).view(np.int64)), pa.array(np.concatenate([n_one, n_two]))], names=["history", "word", "n"])


def _count(is_target: bool, hot_words: np.ndarray, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        total, one, two = np.zeros(2, np.int64), np.zeros(len(hot_words), np.int64), np.zeros(len(hot), np.int64)
        for batch in batches:
            for part in parts(batch, 0, BLOCK_BYTES):
                w, history, _, _ = tokens(words, part.column(0))
                total += len(w), int((history == START).sum())
                is_hot, at = place_in(hot_words, w)
                one += np.bincount(at[is_hot], minlength=len(one))
                same, at = place_in(hot, pair(history[is_hot], w[is_hot]))
                two += np.bincount(at[same], minlength=len(two))
        for kind, n in ((0, total), (1, one), (2, two)):
            some = np.flatnonzero(n)
            zero = np.zeros(len(some), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(zero), kind, np.int32)), pa.array(some), pa.array(n[some] if is_target else zero), pa.array(zero if is_target else n[some])], names=["kind", "key", "target", "background"])

    return run


def _distinct(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in parts(batch, 0, BLOCK_BYTES):
                w = np.unique(tokens(words, part.column(0))[0])
                own = (w % U(partitions)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                w, some = w[order], np.unique(own)
                cuts = np.searchsorted(own[order], np.append(some, partitions))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([w[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["part", "words"])

    return run


def _distinct_here(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"n": pa.array([len(np.unique(np.frombuffer(b"".join(table.column("words").to_pylist()), U)))], pa.int64())})


def packed(x: np.ndarray) -> bytes:
    """Small counts in as few bytes each as the largest needs, after a byte that says how many."""
    width = 1 if x.max(initial=0) < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1) if raw else np.empty(0, np.uint8)


def occurrences(doc: np.ndarray, thing: np.ndarray, n: int) -> np.ndarray:
    """How often each token's thing (below n) is in its document."""
    _, each, count = np.unique(doc * max(1, n) + thing, return_inverse=True, return_counts=True)
    return count[each]


class Frequent:
    """What every block knows: totals of both corpora, target first, and exact counts of the frequent words and bigrams."""

    def __init__(self, total: np.ndarray, vocabulary: int, hot_words: np.ndarray, one: np.ndarray, hot: np.ndarray, ends: np.ndarray, two: np.ndarray) -> None:
        self.mass = (total[:, 0] + 0.5 * vocabulary).astype(np.float64)
        # A text is left out of the background, its start too.
        self.start = np.log2(np.array([total[0, 1], max(0, total[1, 1] - 1)]) + KAPPA)
        self.words, self.counts = hot_words, one
        self.hot, self.pairs, self.ends = hot, two, np.searchsorted(hot_words, ends)

    def loss(self, side: int, pairs: np.ndarray, last: np.ndarray) -> np.ndarray:
        """-log2(c(hw) + K p(w)) of bigrams' counts and counts of their last words."""
        return -np.log2(pairs + KAPPA * (last + 0.5) / self.mass[side])


def _cells(is_target: bool, partitions: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        block = (TaskContext.get().partitionId() << 32) + (1 << 62) * is_target
        for batch in batches:
            for part in parts(batch, 0, BLOCK_BYTES):
                w, history, doc, last = tokens(words, part.column(0))
                is_hot, at = place_in(model.words, w)
                key = pair(history, w)
                here, spot = place_in(model.hot, key)
                goes_on = is_hot & ~last
                starts = np.bincount(doc[history == START], minlength=len(part))
                own = np.zeros(len(w), np.int64)
                own[is_hot] = occurrences(doc[is_hot], at[is_hot], len(model.words))
                twin = occurrences(doc[here], spot[here], len(model.hot))
                local = np.zeros((3, len(part)))
                for side, out, out_twin in ((0, np.zeros_like(own), np.zeros_like(twin)), (1, own, twin)):
                    if len(model.words):
                        follow = np.log2(model.counts[side][at[goes_on]] - out[goes_on] + KAPPA)
                        local[side] += np.bincount(doc[goes_on], follow, len(part))
                    if len(model.hot):
                        cost = model.loss(side, model.pairs[side][spot[here]] - out_twin, model.counts[side][model.ends[spot[here]]] - out[here])
                        local[side] += np.bincount(doc[here], cost, len(part))
                    local[side] += starts * model.start[side]
                local[2] = np.bincount(doc[here], minlength=len(part))
                # The last word of a text is no history: a mark with it takes one back, where the word's owner sums.
                marks = np.flatnonzero(last & ~is_hot) if not is_target else np.empty(0, np.int64)
                away = np.flatnonzero(~here)
                hot = np.concatenate([is_hot[away], np.zeros(len(marks), dtype=bool)])
                own = np.concatenate([own[away], np.zeros(len(marks), np.int64)])
                history = np.concatenate([history[away], np.full(len(marks), END)])
                key = np.concatenate([key[away], pair(np.full(len(marks), END), w[marks])])
                w, doc = np.concatenate([w[away], w[marks]]), np.concatenate([doc[away], doc[marks]])
                owner = np.where(hot, key, mix(w)) % U(partitions)
                place = np.zeros(len(doc), U) if is_target else doc.astype(U)
                order = np.lexsort((place, history, w, owner))
                w, history, place, owner, hot, own = w[order], history[order], place[order], owner[order].astype(np.int64), hot[order], own[order]
                new_word = np.ones(len(w), dtype=bool)
                new_word[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
                new = new_word.copy()
                new[1:] |= (history[1:] != history[:-1]) | (place[1:] != place[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(w)))
                w, history, place, owner, new_word, hot, own = w[first], history[first], place[first], owner[first], new_word[first], hot[first], own[first]
                heads = np.flatnonzero(new_word)
                runs = np.diff(np.append(heads, len(w)))
                some = np.unique(owner)
                if not is_target:
                    some = np.union1d(some, [block % partitions])  # the block's documents travel with one cell, even where it has no bigram
                lo, hi = np.searchsorted(owner, some), np.searchsorted(owner, some, side="right")
                head_lo, head_hi = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
                cols: list[list] = [[] for _ in range(8)]
                for p, a, b, c, d in zip(some, lo, hi, head_lo, head_hi, strict=True):
                    own_docs = not is_target and p == block % partitions
                    cols[0].append(w[heads[c:d]].tobytes())
                    cols[1].append(packed(runs[c:d]))
                    cols[2].append(history[a:b].tobytes())
                    cols[3].append(packed(n[a:b]))
                    cols[4].append(place[a:b].astype(np.uint16).tobytes())
                    cols[5].append(np.array([x if x is not None else 0 for x in part.column(1).to_pylist()], np.int64).tobytes() + np.array(part.column(1).is_valid(), dtype=np.uint8).tobytes() if own_docs else b"")
                    cols[6].append(local.tobytes() if own_docs else b"")
                    cols[7].append(b"" if is_target else packed(own[a:b][hot[a:b]]))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block, np.int64)), pa.array(np.full(len(some), is_target)), *[pa.array(c, pa.binary()) for c in cols]], names=[x.split()[0] for x in _CELL.split(", ")])
                block += 1

    return run


def _answer(shared):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        model: Frequent = shared.value
        rows = table.to_pydict()
        load = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name]]
        history, places = load("keys", U), load("places", np.uint16)
        runs, n, own = ([unpacked(x) for x in rows[name]] for name in ("runs", "counts", "own"))
        words, head = np.unique(np.concatenate(load("words", U)), return_inverse=True)
        last = np.repeat(head, np.concatenate(runs).astype(np.int64))
        before, often = np.concatenate(history), np.concatenate(n).astype(np.float64)
        side = np.repeat(np.where(rows["is_target"], 0, 1), [len(x) for x in n])
        some, each = np.unique(pair(before, words[last]), return_inverse=True)
        real = before != END
        one, two = np.zeros((2, len(words))), np.zeros((2, len(some)))
        for s in range(2):
            mine = real & (side == s)
            one[s] = np.bincount(last[mine], often[mine], len(words))
            two[s] = np.bincount(each[mine], often[mine], len(some))
        is_hot, at = place_in(model.words, words)
        one[:, is_hot] = model.counts[:, at[is_hot]]
        blocks, docs, sums = [], [], []
        a = 0
        for block, target, ids, local, p, told in zip(rows["block"], rows["is_target"], rows["docs"], rows["local"], places, own, strict=True):
            e, w, r, c = each[a : a + len(p)], last[a : a + len(p)], real[a : a + len(p)], often[a : a + len(p)]
            a += len(p)
            if target:
                continue
            # What the document itself adds to a word: told of frequent words, else all its bigrams that end in it are here.
            _, group = np.unique(w * (1 << 16) + p, return_inverse=True)
            out = np.bincount(group, c * r)[group] if len(p) else np.empty(0)
            hot = is_hot[w]
            out[hot] = told
            cost = []
            for side, mine, pairs in ((0, one[0, w], two[0, e]), (1, one[1, w] - out, two[1, e] - c * r)):
                follow = np.where(hot, 0.0, np.log2(mine + KAPPA))
                cost.append(np.where(r, model.loss(side, np.where(r, pairs, 0.0), mine) + follow, -follow))
            found, spot = np.unique(p, return_inverse=True)
            blocks.append(block)
            docs.append(ids)
            part = np.concatenate([found.astype(np.float32), *[np.bincount(spot, c * v, len(found)).astype(np.float32) for v in (*cost, r)]])
            sums.append(np.int64(len(local)).tobytes() + local + part.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())})

    return run


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    ids = next(x for x in rows["docs"] if x)
    n = len(ids) // 9
    total = np.zeros((3, n))
    for raw in rows["sums"]:
        size = int(np.frombuffer(raw[:8], np.int64)[0])
        if size:
            total += np.frombuffer(raw[8 : 8 + size], np.float64).reshape(3, n)
        part = np.frombuffer(raw[8 + size :], np.float32).reshape(4, -1)
        total[:, part[0].astype(np.int64)] += part[1:]
    doc = pa.array(np.frombuffer(ids[: 8 * n], np.int64), mask=np.frombuffer(ids[8 * n :], np.uint8) == 0)
    return pa.table({"doc_id": doc, "t": total[0], "b": total[1], "n": total[2]})


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every document.

    ``docs`` (doc_id, text) is scored and is the background; ``target`` (text)
    is the other model's corpus.
    """
    spark = docs.sparkSession
    texts, own = pinned(docs, "text", "doc_id"), pinned(target, "text")
    looked = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(_common, "history long, word long, n long").groupBy("history", "word").agg(F.sum("n").alias("n"))
    looked = looked.where(F.col("n") >= 32).orderBy(F.desc("n"), "history", "word").limit(int(2 / HOT)).collect()
    history, word, often = (np.array([r[c] for r in looked], dtype=np.int64) for c in ("history", "word", "n"))
    history, word = history.view(U), word.view(U)
    often_enough = often >= HOT * max(1, often[history == END].sum())
    chosen = often_enough & (history != END)
    hot, first = np.unique(pair(history[chosen], word[chosen]), return_index=True)
    ends, hot_words = word[chosen][first], np.unique(word[often_enough])

    seen = texts.select("text").mapInArrow(_count(False, hot_words, hot), _COUNTS).unionAll(own.mapInArrow(_count(True, hot_words, hot), _COUNTS)).groupBy("kind", "key").agg(F.sum("target").alias("t"), F.sum("background").alias("b")).collect()
    counted = tuple(np.zeros((2, n), np.int64) for n in (2, len(hot_words), len(hot)))
    for row in seen:
        counted[row["kind"]][:, row["key"]] = row["t"], row["b"]
    total, one, two = counted
    partitions = int(min(MOST_PARTITIONS, max(1, total[1, 0] // TOKENS_PER_PARTITION)))
    each = texts.select("text").unionAll(own).mapInArrow(_distinct(partitions), "part int, words binary").groupBy("part").applyInArrow(_distinct_here, "n long")
    vocabulary = max(CLASSES, each.agg(F.sum("n")).first()[0] or 0)
    shared = share(spark, Frequent(total, vocabulary, hot_words, one, hot, ends, two))

    cells = texts.mapInArrow(_cells(False, partitions, shared), _CELL).unionAll(own.mapInArrow(_cells(True, partitions, shared), _CELL))
    sums = cells.groupBy("part").applyInArrow(_answer(shared), _SUMS)
    by_doc = sums.groupBy("block").applyInArrow(_gather, "doc_id long, t double, b double, n double").groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in "tbn"])
    mean = lambda c: F.when(F.col("n") > 0, F.round(c / F.col("n"), 4))
    return by_doc.select("doc_id", F.col("n").cast("long").alias("n_tokens"), mean(F.col("t")).alias("loss_target"), mean(F.col("b")).alias("loss_background"), mean(F.col("t") - F.col("b")).alias("score"))
