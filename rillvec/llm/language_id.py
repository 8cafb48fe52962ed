"""Language ID with language-bitmask n-gram filters.

Every language keeps the set of the four-byte n-grams that are typical of it.
All sets live in one bit-sliced Bloom filter: a slot holds a mask with one bit
a language, an n-gram sets its language's bit in ``HASHES`` slots, and the AND
of an n-gram's slots is the mask of all languages that contain it.  For a text
the masks of all its n-grams are popcounted per language; each count is
corrected for the filter's false positives, whose rate follows from the share
of slots that the language fills, and the largest corrected share decides.

Training reads a bounded sample of the labelled rows: about ``SAMPLE``
documents a language, chosen by hash.  Prediction reads every text whole.

Edge cases: a null text or one without a letter is ``und`` with score 0; with
no labelled row every text is ``und``; a text whose n-grams no language holds
gets the language with most labelled rows and score 0; equal shares fall to
the language with more rows; repeated rows come out as often as they came in;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillvec.plans.shared import share

from ._native import pinned
from ._words import U, mix, parts, utf8

N = 4
HASHES = 2
#: Labelled documents a language that training reads, in expectation.
SAMPLE = 2000
#: An n-gram belongs to a language if it stands in this share of its sampled documents ...
LEAST_SHARE = 0.01
#: ... and in at least this share relative to the language where it is most frequent.
RELATIVE = 0.25
#: Any character of Unicode's category L; numerals and fractions are not letters.
_LETTER = r"\p{L}"


def grams(data: np.ndarray) -> np.ndarray:
    """All N-byte windows as 32-bit integers."""
    if len(data) < N:
        return np.empty(0, np.uint32)
    wide = data.astype(np.uint32)
    out = wide[: len(data) - N + 1].copy()
    for j in range(1, N):
        out = (out << np.uint32(8)) | wide[j : j + len(out)]
    return out


def _owned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that lie within one text, padded by a blank, and where each text's start."""
    padded = pc.binary_join_element_wise("", pc.fill_null(pc.utf8_lower(texts), ""), "", " ")
    data, off = utf8(padded)
    g = grams(data)
    inside = np.ones(len(g), dtype=bool)
    for j in range(1, N):
        x = off[1:] - j
        inside[x[(x >= 0) & (x < len(g))]] = False
    before = np.concatenate([[0], np.cumsum(inside)])
    return g[inside], before[np.minimum(off, len(g))]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 0):
            g, off = _owned(part.column(0))
            for lang in pc.unique(part.column(1)).to_pylist():
                mine = np.flatnonzero(pc.equal(part.column(1), lang).to_numpy(zero_copy_only=False))
                one = [np.unique(g[off[i] : off[i + 1]]) for i in mine]
                keys, n = np.unique(np.concatenate(one), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slots[plane, slot]`` has a bit for each of 64 languages."""

    langs: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    @classmethod
    def build(cls, langs: list[str], sets: list[np.ndarray]) -> Filters:
        size = 1 << max(12, int(np.ceil(np.log2(16 * max([1, *map(len, sets)])))))
        slots = np.zeros((max(1, -(-len(langs) // 64)), size), dtype=U)
        wrong = np.zeros(len(langs))
        for k, own in enumerate(sets):
            bit = U(1) << U(k % 64)
            for place in cls.places(own, size):
                slots[k // 64, np.unique(place)] |= bit
            wrong[k] = np.mean(slots[k // 64] & bit != 0) ** HASHES
        return cls(langs, slots, wrong)

    @staticmethod
    def places(g: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(g.astype(U))
        return [((h >> U(32 * j)) & U(size - 1)).astype(np.int64) for j in range(HASHES)]

    def shares(self, g: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected share of n-grams in each language: (texts, languages)."""
        n = np.diff(off)
        out = np.zeros((len(n), len(self.langs)))
        places = self.places(g, self.slots.shape[1])
        some = np.flatnonzero(n > 0)
        for plane, slots in enumerate(self.slots):
            mask = slots[places[0]]
            for place in places[1:]:
                mask &= slots[place]
            for k in range(64 * plane, min(64 * plane + 64, len(self.langs))):
                hits = ((mask >> U(k % 64)) & U(1)).astype(np.uint8)
                out[some, k] = np.add.reduceat(hits, off[:-1][some], dtype=np.int64) / n[some] if len(some) else 0
        return np.clip((out - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0, 1)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters of all languages of ``labelled`` (doc_id, text, lang; lang not null)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return Filters.build([], [])
    # A language's documents whose hash falls below its share: about ``sample`` of them.
    share = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / counts[lang]))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    seen = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share_of = F.lit(None).cast("double")
    for lang in langs:
        share_of = F.when(F.col("lang") == lang, F.col("n") / F.lit(max(1, seen.get(lang, 0)))).otherwise(share_of)
    found = chosen.select("text", "lang").mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", "gram", share_of.alias("share")).where(F.col("share") >= LEAST_SHARE).toPandas()
    top = found.groupby("gram")["share"].transform("max")
    kept = found[found["share"] >= RELATIVE * top]
    return Filters.build(langs, [np.sort(kept[kept["lang"] == x]["gram"].to_numpy(dtype=np.int64)).astype(np.uint32) for x in langs])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        for batch in batches:
            for part in parts(batch, 1):
                g, off = _owned(part.column(1))
                lettered = pc.fill_null(pc.match_substring_regex(part.column(1), _LETTER), False).to_numpy(zero_copy_only=False)
                if filters.langs:
                    shares = filters.shares(g, off)
                    best = shares.argmax(axis=1)
                    score = shares[np.arange(len(best)), best] / np.maximum(shares.sum(axis=1), 1e-12)
                    names = np.array(filters.langs, dtype=object)[best]
                else:
                    score, names = np.zeros(len(part)), np.full(len(part), "und", dtype=object)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.where(lettered, names, "und").tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score; ``docs`` has doc_id, text and held_out."""
    shared = share(docs.sparkSession, filters)
    return pinned(docs, "doc_id", "text", "held_out").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    rows = pinned(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(rows, fit(rows.where(~F.col("held_out")), sample))
