"""Quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are measures of the line and of the
lines before and after it; labels of neighbouring lines are tied by transition
weights.  Marginals come from forward-backward, and a document's score is the
mean of its lines' marginals weighted by their length.

Labels are of documents, line labels are hidden: each line is taken to agree
with its document's label but for a share ``DOUBT`` of lines.  The gradient is
the expected counts with the document's label given less those without, so a
line that looks like the other kind may be of the other kind, and good lines
may follow bad ones.  Training reads a bounded sample of the labelled rows:
about ``SAMPLE`` documents of each label, chosen by hash, and of a document of
more than ``TRAIN_LINES`` lines a stretch of that many, which starts where a
hash of its id says; scoring reads every text whole.  As the sample takes more
of the rarer label than there is, scores are corrected for the two shares: the
odds are multiplied by the labels' true ratio over the sample's.

Edge cases: a null or empty text is one empty line; without labelled rows each
score is 0.5; several labels of one document count as 1 if any is; repeated
rows come out as often as they came in; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillvec.plans.shared import share

from ._native import pinned
from ._words import U, Words, mix, parts, utf8
from .language_id import held_out

SAMPLE = 1500
TRAIN_LINES = 300
THRESHOLD = 0.7
STEPS = 150
#: Share of lines that are not of their document's kind.
DOUBT = 0.05
#: Decay of line weights and of moves between labels, a step.
DECAY, MOVE_DECAY = 1e-4, 1e-2

_SYMBOLS = b"#*$%&|<>^~{}[]\\=@_+"


def _class_table() -> np.ndarray:
    """Byte to class: 0 other, 1 symbol, 2 digit, 3 upper, 4 lower or not ASCII, 5 blank, 6 stop mark, 7 call mark."""
    t = np.zeros(256, np.uint8)
    t[list(_SYMBOLS)] = 1
    t[48:58] = 2
    t[65:91] = 3
    t[97:123] = 4
    t[128:] = 4
    t[[32, 9, 11, 12, 13]] = 5
    t[list(b".,;:")] = 6
    t[list(b"!?")] = 7
    return t


_GOLD = U(0x9E3779B97F4A7C15)
_OWN = 9
WIDTH = 1 + 3 * _OWN + 2


def line_features(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and where each text's lines start."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    lines = split.flatten()
    starts = np.asarray(split.offsets).astype(np.int64)
    starts = starts - starts[0]
    data, off = utf8(lines)
    size = np.diff(off)
    kinds = _class_table()[data]
    counts = np.zeros((8, len(size)))
    long = np.flatnonzero(size)
    for k in range(1, 8):
        if len(long):
            counts[k][long] = np.add.reduceat((kinds == k).view(np.uint8), off[:-1][long], dtype=np.int64)
    h, wo = words.of(lines)
    n = np.diff(wo)
    line_of = np.repeat(np.arange(len(n), dtype=U), n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    twice = np.bincount(line_of.astype(np.int64), same, len(n)) if len(h) else np.zeros(len(n))
    with np.errstate(over="ignore"):
        _, once = np.unique(mix(line_of * _GOLD + h), return_index=True)
    distinct = np.bincount(line_of[once].astype(np.int64), minlength=len(n))
    doc_of = np.repeat(np.arange(len(starts) - 1, dtype=U), np.diff(starts))
    print_of = np.zeros(len(n), dtype=U)
    with np.errstate(over="ignore"):
        some = np.flatnonzero(n > 0)
        if len(some):
            print_of[some] = np.add.reduceat(h, wo[:-1][some])
        _, first, group = np.unique(mix(doc_of * _GOLD + print_of), return_index=True, return_inverse=True)
    seen = (first[group] < np.arange(len(n))) & (n > 0)
    length = np.maximum(size, 1)
    letters = np.maximum(counts[3] + counts[4], 1)
    own = np.stack(
        [
            np.log1p(size) / 6,
            np.minimum(1, 8 * counts[1] / length),
            np.minimum(1, 4 * counts[2] / length),
            counts[3] / letters,
            np.minimum(1, 8 * counts[7] / length),
            np.minimum(1, 8 * counts[6] / length),
            np.minimum(2, size / np.maximum(n, 1) / 10),
            1 - distinct / np.maximum(n, 1),
            np.maximum(seen, np.minimum(1, 2 * twice / np.maximum(n, 1))),
        ],
        axis=1,
    ).reshape(len(n), _OWN)
    x = np.zeros((len(n), WIDTH), dtype=np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + _OWN] = own
    joined = doc_of[1:] == doc_of[:-1]
    x[1:, 1 + _OWN : 1 + 2 * _OWN][joined] = own[:-1][joined]
    x[:-1, 1 + 2 * _OWN : 1 + 3 * _OWN][joined] = own[1:][joined]
    x[1:, -2][joined] = 1
    x[:-1, -1][joined] = 1
    return x, size, starts


@dataclass
class Crf:
    """Line weights, and log potentials of (label, next label)."""

    weights: np.ndarray
    moves: np.ndarray
    odds: float = 1.0

    def run(self, unary: np.ndarray, starts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the label good for all lines; if asked, expected counts of label pairs.

        All texts step together, longest first, so a step handles those that are long enough.
        """
        t = np.exp(self.moves)
        u = np.exp(np.clip(unary, -30, 30))
        n = np.diff(starts)
        order = np.argsort(-n, kind="stable")
        at, length = starts[:-1][order], n[order]
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        ahead, back = np.empty(len(u)), np.ones(len(u))
        for step, k in enumerate(live):
            i = at[:k] + step
            if step:
                p = ahead[i - 1]
                good, bad = p * t[1, 1] + (1 - p) * t[0, 1], p * t[1, 0] + (1 - p) * t[0, 0]
                ahead[i] = good * u[i] / (good * u[i] + bad)
            else:
                ahead[i] = u[i] / (1 + u[i])
        total = np.zeros((2, 2))
        for step in range(len(live) - 1, 0, -1):
            i = at[: live[step]] + step - 1
            r = u[i + 1] * back[i + 1]
            back[i] = (t[1, 1] * r + t[1, 0]) / (t[0, 1] * r + t[0, 0])
            if pairs:
                p = ahead[i]
                joint = np.stack([(1 - p) * t[0, 0], (1 - p) * t[0, 1] * r, p * t[1, 0], p * t[1, 1] * r])
                total += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return ahead * back / (ahead * back + 1 - ahead), total

    def score(self, words: Words, texts: pa.Array) -> np.ndarray:
        x, size, starts = line_features(words, texts)
        good = self.run(x @ self.weights, starts)[0]
        weight = size + 1.0
        mean = np.clip(np.add.reduceat(good * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1]), 0, 1)
        return self.odds * mean / (self.odds * mean + 1 - mean)


def train(x: np.ndarray, starts: np.ndarray, label: np.ndarray, steps: int = STEPS, doubt: float = DOUBT) -> Crf:
    """Gradient ascent (Adam) of the likelihood of the documents' labels, with the lines' own labels summed out."""
    crf = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    n = np.diff(starts)
    lean = np.repeat(np.where(label == 1, 1.0, -1.0), n) * np.log((1 - doubt) / doubt)
    decay = np.concatenate([np.full(x.shape[1], DECAY), np.full(4, MOVE_DECAY)])
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        unary = x @ crf.weights
        good, pairs = crf.run(unary, starts, pairs=True)
        told, told_pairs = crf.run(unary + lean, starts, pairs=True)
        grad = np.concatenate([x.T @ (told - good), (told_pairs - pairs).ravel()]) / max(1, len(x))
        grad -= decay * np.concatenate([crf.weights, crf.moves.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        crf.weights = crf.weights + move[:-4]
        crf.moves = crf.moves + move[-4:].reshape(2, 2)
    return crf


def stretch(n: int, doc_id: int | None) -> slice:
    """All lines, or of more than ``TRAIN_LINES`` that many from where a hash of the id says."""
    if n <= TRAIN_LINES:
        return slice(0, n)
    at = zlib.crc32(str(doc_id).encode()) % (n - TRAIN_LINES + 1)
    return slice(at, at + TRAIN_LINES)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in parts(batch, 0):
            x, _, starts = line_features(words, part.column(0))
            raw = [x[a:b][stretch(b - a, i)].astype(np.float32).tobytes() for a, b, i in zip(starts[:-1], starts[1:], part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(raw, pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """A field trained on a sample of the labelled documents; None without labels."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # At most about two samples of ids, whatever the input: small enough to broadcast.
    rows = pinned(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label").mapInArrow(_lines, "doc_id long, label int, x binary").orderBy("doc_id", "x").collect()
    if not rows:
        return None
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    label = np.array([r["label"] for r in rows])
    crf = train(np.concatenate(x), np.concatenate([[0], np.cumsum([len(a) for a in x])]), label)
    if counts.get(0) and counts.get(1) and 0 < label.sum() < len(label):
        crf.odds = (counts[1] / counts[0]) / (label.sum() / (len(label) - label.sum()))
    return crf


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, crf = Words(), shared.value
        for batch in batches:
            for part in parts(batch, 1):
                score = crf.score(words, part.column(1)) if crf else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held-out rows lend no label."""
    rows = pinned(docs, "doc_id", "text").withColumn("held_out", held_out())
    crf = fit(rows, pinned(labels, "doc_id", "quality").where(~held_out()), sample)
    shared = share(docs.sparkSession, crf)
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
