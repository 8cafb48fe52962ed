"""Vectorised words, hashes and shingles of text batches.

A batch of texts is lower-cased, cut into words (runs of ASCII letters and
digits, underscores and all non-ASCII characters) and each word becomes a
64-bit hash: a polynomial over random byte values, taken from prefix sums, so
no Python code runs for a single word.  Work goes on in pieces of about a
quarter megabyte; beyond the words' hashes nothing grows with a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256)
    letter = (codes >= 128) | ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 48) & (codes <= 57)) | (codes == 95)
    with np.errstate(over="ignore"):
        return letter, mix(np.arange(1, 257, dtype=U) * _BASE) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** i and its inverse, for i up to n, modulo 2**64."""
    inverse = U(pow(int(_STEP), -1, 1 << 64))
    out = []
    for base in (_STEP, inverse):
        p = np.full(n + 1, base, dtype=U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Words:
    """Cuts batches of texts into hashed words."""

    def __init__(self) -> None:
        self.letter, self.value = _tables()
        self.up, self.down = _powers(PIECE + 4096)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and offsets: text i has words off[i]:off[i+1]."""
        data, ends = utf8(pc.utf8_lower(texts))
        hashes, starts = [], []
        at = 0
        with np.errstate(over="ignore"):
            while at < len(data):
                to = self._cut(data, at)
                h, s = self._piece(data[at:to], ends, at)
                hashes.append(h)
                starts.append(s + at)
                at = to
        h = np.concatenate(hashes) if hashes else np.empty(0, U)
        s = np.concatenate(starts) if starts else np.empty(0, np.int64)
        return h, np.searchsorted(s, ends)

    def _cut(self, data: np.ndarray, at: int) -> int:
        to = min(len(data), at + PIECE)
        while to < len(data):
            free = np.flatnonzero(~self.letter[data[to : to + 4096]])
            if len(free):
                return to + int(free[0])
            to = min(len(data), to + 4096)
        return to

    def _piece(self, data: np.ndarray, ends: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        self._grow(len(data))
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = self.letter[data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cuts = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + len(data))] - at
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        first[cuts] = True
        last[cuts - 1] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.value[data] * self.up[: len(data)], out=total[1:])
        return mix((total[e] - total[s]) * self.down[s] + (e - s).astype(U)), s


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[off[0] : off[-1]] if body is not None and len(texts) else np.empty(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, in order, and offsets.

    A text of fewer than k words has one shingle, of all its words; a text
    without words has none.
    """
    n = np.diff(off)
    out = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    so = np.concatenate([[0], np.cumsum(out)])
    if not len(h):
        return np.empty(0, U), so
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - k + 1), dtype=U)
        for j in range(k):
            run = run * _STEP + h[j : j + len(run)]
        run = mix(run)
        fits = np.ones(len(run), dtype=bool)
        for j in range(1, k):
            x = off[1:] - j
            fits[x[(x >= 0) & (x < len(run))]] = False
        s = np.empty(so[-1], dtype=U)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = np.ones(len(s), dtype=bool)
        whole[so[short]] = False
        s[whole] = run[fits]
        for i in short:
            x = U(int(n[i]))
            for w in h[off[i] : off[i + 1]]:
                x = x * _BASE + w
            s[so[i]] = mix(np.array([x], dtype=U))[0]
    return s, so


def parts(batch: pa.RecordBatch, text: int, size: int = 1 << 21, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes; a longer text stands alone."""
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(length)
    at, done = 0, 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, done + size)))
        to = min(to, at + rows, len(length))
        yield batch.slice(at, to - at)
        at, done = to, ends[to - 1]
