"""Words, word hashes and word n-gram hashes of whole batches of texts, by numpy.

A word's hash mixes its bytes, eight at a time, into 64 bits. An n-gram's hash is a polynomial of
its words' hashes in an odd multiplier modulo 2^64, so prefix sums give that of any range of words;
a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(word: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in word:
        t[a : b + 1] = True
    return t


#: Anything but ASCII white space (0x20, 0x09-0x0D).
NON_SPACE = ~_table([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII digits, lower-case letters, and every byte of a non-ASCII character.
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a multiplier, and of its inverse."""
    have = _POW.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        m = _MULT[which] | 1
        inv = pow(m, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(x))]), dtype=_U) for x in (m, inv))
        _POW[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of several texts, text after text.

    ``start``/``end``: byte range of each word in ``buf`` (lower-cased if asked);
    ``first``: of each text, its first word's number (one entry more than texts);
    ``base``: of each text, its first byte in ``buf``.
    """

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        buf = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        self.base = offsets - low
        self.buf = _LOWER[buf] if lower else buf
        inside = table[self.buf]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.base] = True  # a text begins or ends here
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.start, self.base)
        self.n = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Of each word, its text's number."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes after eight are mixed in, those beyond the word masked."""
        if not self.n:
            return np.zeros(0, _U)
        data = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        lane = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each place on
        size = self.end - self.start
        h = mix(size.astype(_U) + _U(_MULT[0]))
        live, at = np.arange(self.n), 0
        with np.errstate(over="ignore"):
            while len(live):
                left = size[live] - at
                keep = np.minimum(left, 8).astype(_U) * _U(8)
                bits = lane[self.start[live] + at] & np.where(keep == 64, ~_U(0), (_U(1) << (keep & _U(63))) - _U(1))
                h[live] = mix((h[live] ^ bits) * _U(_MULT[1]) + _U(1))
                at += 8
                live = live[left > 8]
                if at >= 512:  # the few words that go on are hashed one by one
                    for i in live.tolist():
                        h[i] ^= _U(xxhash.xxh64_intdigest(self.buf[self.start[i] + at : self.end[i]].tobytes(), int(h[i]) & 0xFFFF))
                    break
        return h

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of ``buf``, by prefix sums: for features, as texts can be made that share them."""
        if not len(start):
            return np.zeros(0, _U)
        p, inv = powers(len(self.buf))
        with np.errstate(over="ignore"):
            if not hasattr(self, "_sums"):
                self._sums = np.concatenate([[_U(0)], np.cumsum((self.buf.astype(_U) + _U(1)) * p[: len(self.buf)], dtype=_U)])
            return mix((self._sums[end] - self._sums[start]) * inv[start] + (end - start).astype(_U))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The words, each followed by one space, and where each begins (one entry more): a run of words is one byte range."""
        to = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        flat = np.full(int(to[-1]), 0x20, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[to[1:] - 1] = False
        edge = np.zeros(len(self.buf) + 1, np.int8)
        edge[self.start] += 1
        np.add.at(edge, self.end, -1)
        flat[inner] = self.buf[np.cumsum(edge[:-1]).astype(bool)]
        return flat.tobytes(), to


def ngrams(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; the last k-1 places have none.

    Texts are not told apart here: see ``inside``.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    p, inv = powers(len(h), which)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(h * p[: len(h)], dtype=_U)])
        return mix((sums[k:] - sums[:n]) * inv[:n] + _U(k))


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the k words from each place on lie in one text (for ``ngrams``)."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    bad = np.zeros(n + 1, np.int64)
    lo = np.clip(first[1:] - k + 1, 0, n)
    hi = np.clip(first[1:], 0, n)
    np.add.at(bad, lo, 1)
    np.add.at(bad, hi, -1)
    ok &= np.cumsum(bad[:n]) <= 0
    return ok
