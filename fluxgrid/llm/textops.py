"""Word and shingle hashing over chunks of texts, in numpy.

A word is a maximal run of bytes other than blank and 0x09-0x0D, the class
``[^\\x20\\x09-\\x0D]+``; UTF-8 keeps those bytes out of other characters, so
working on bytes is exact. Hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}
#: Odd multipliers of the words of a shingle, from the generator below.
_STEPS = (np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) << U(1)) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 and its inverse's, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, U)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """The words of a chunk of texts: hash, text, first and past-the-end byte of each."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    doc_starts: np.ndarray
    counts: np.ndarray

    def raw(self) -> bytes:
        return self.buf.tobytes()


def words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of every text; with lower, A-Z count as a-z."""
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    if lower:
        buf = _LOWER[buf]
    blank = _BLANK[buf]
    before = np.empty_like(blank)
    before[0] = True
    before[1:] = blank[:-1]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U)
    total[0] = 0
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return Words(buf, starts, ends, doc, h, doc_starts, np.bincount(doc, minlength=len(texts)).astype(np.int64))


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` consecutive words of one text, and the index of its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    if size <= len(_STEPS):
        g = np.zeros(n, U)
        for j in range(size):
            g += h[j : j + n] * _STEPS[j]
        return mix(g[at]), at
    up, down = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[: len(h)])])
    return mix((total[size:] - total[:-size])[at] * down[at]), at


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and each text's bounds (n + 1).

    Words are lower-cased; a text of fewer than `size` words has one shingle, the whole sequence; without words none.
    """
    w = words(texts, lower=True)
    g, at = windows(w.hash, w.doc, size)
    d = w.doc[at]
    first = np.cumsum(w.counts) - w.counts
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = np.zeros(len(short), U)
        for j in range(size - 1):
            has = w.counts[short] > j
            extra[has] += w.hash[first[short[has]] + j] * _STEPS[j]
        g = np.concatenate([g, mix(extra + w.counts[short].astype(U) * U(0xA0761D6478BD642F))])
        d = np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(texts) + 1))
