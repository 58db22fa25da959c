"""Vectorised word scanning: words are runs of bytes other than 0x20 and 0x09-0x0D."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of consecutive texts. doc_start[i]:doc_start[i+1] are the words of text i."""

    data: np.ndarray  # bytes of all texts, one after another
    text_start: np.ndarray  # byte offsets of the texts
    start: np.ndarray  # byte offsets of the words
    stop: np.ndarray
    doc_start: np.ndarray
    inside: np.ndarray  # bytes that belong to words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_start)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.doc_start) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z taken as a-z if `lower`."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        salt = _SALT[_LOWER] if lower else _SALT
        np.cumsum(salt[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.stop] - sums[self.start]) * down[self.start]
        return mix(h ^ ((self.stop - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def word(self, i: int, lower: bool = False) -> bytes:
        w = self.data[self.start[i] : self.stop[i]].tobytes()
        return w.lower() if lower else w


def scan(texts: pa.Array) -> Words:
    """Find the words of a large_string array without nulls."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    text_start = ends - ends[0]
    inside = ~_SPACE[raw]
    size = len(raw)
    if not size:
        empty = np.zeros(0, np.int64)
        return Words(raw, text_start, empty, empty, np.zeros(n + 1, np.int64), inside)
    first = np.empty(size, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[text_start[:-1][text_start[:-1] < size]] = True
    first &= inside
    last = np.empty(size, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cut = text_start[1:] - 1
    last[cut[cut >= 0]] = True
    last &= inside
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(raw, text_start, start, stop, np.searchsorted(start, text_start), inside)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashes, in order; ends of texts are the caller's concern."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mix(out)
