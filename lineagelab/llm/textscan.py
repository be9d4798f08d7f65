"""Vectorised scanning of Arrow string columns inside tasks.

Works on the UTF-8 bytes of a whole batch at once: a byte of a non-ASCII
character is >= 0x80, so the word definition of the package (runs of digits,
letters and non-ASCII characters) is a property of single bytes. Every document
is scanned whole; batches are cut only between documents, at about
``SLICE_BYTES`` of text, to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240731)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(texts: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer single document stands alone)."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def raw_bytes(texts: pa.LargeStringArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows lo..hi-1 and the offsets of the rows in them."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + lo:texts.offset + hi + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] \
        else np.zeros(0, dtype=np.uint8)
    return buf, off - off[0]


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of every string of a (small) array."""
    texts = strings.cast(pa.large_string())
    buf, off = raw_bytes(texts, 0, len(texts))
    up, down = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=acc[1:])
    return mix((acc[off[1:]] - acc[off[:-1]]) * down[off[:-1]] + (off[1:] - off[:-1]).astype(np.uint64))


class Words:
    """Words of a slice of documents: byte starts / ends, 64-bit hashes, words per document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        n = len(buf)
        self.buf, self.offsets = buf, offsets
        isw = IS_WORD[buf]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]       # starts of non-empty documents
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = edge[n] = True
        edge[1:n] = isw[1:] != isw[:-1] if n else False
        edge[filled] = True
        opens = edge[:n] & isw
        closes = edge[1:] & isw
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        up, down = _powers(n)
        acc = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[LOWER[buf]] * up, out=acc[1:])
        self.hashes = mix((acc[self.ends] - acc[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, offsets)       # first word of each document, then the total
        self.counts = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word runs starting at each word, and whether the run stays in its document."""
        w = self.hashes
        total = len(w)
        if not total:
            return w, np.zeros(0, dtype=bool)
        h = np.zeros(total, dtype=np.uint64)
        for j in range(n):
            h[:total - j] += w[j:] * _GRAM[j]
        last = np.repeat(self.first[1:], self.counts)
        return mix(h + np.uint64(n)), np.arange(total) + n <= last


def gram_hash(words: np.ndarray) -> np.uint64:
    """Hash of one run of word hashes, as ``Words.grams`` gives it."""
    h = np.zeros(1, dtype=np.uint64)
    for j, x in enumerate(words):
        h += np.uint64(x) * _GRAM[j:j + 1]
    return mix(h + np.uint64(len(words)))[0]


def scan(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Words]]:
    texts = strings(column)
    for lo, hi in slices(texts):
        yield lo, hi, Words(*raw_bytes(texts, lo, hi))
