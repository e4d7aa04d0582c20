"""Words of Arrow text columns by numpy: positions and hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are hashed in blocks of so many bytes.
BLOCK = 1 << 20
#: Longer words are hashed one by one: a polynomial modulo 2^64 takes some pairs of very long words for one another.
LONG = 64
#: Batches are cut into slices of about so many bytes of text, at least one text each.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def letters(outside: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (all but the ASCII characters of ``outside``), and what each
    byte stands for (A-Z in lower case if asked for)."""
    keep, value = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    keep[[ord(c) for c in outside]] = False
    if lower:
        value[65:91] += 32
    return keep, value


ALNUM = letters("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
SPACED = letters(" \t\n\v\f\r")
PIECES = letters(" \t\n\v\f\r", lower=False)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in order, a bounded number of bytes of text at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE, "right")))
        yield batch.slice(a, b - a)
        a = b


class Words:
    """data: bytes after folding; inside: which of them belong to words; start, end: of each word; first: index of the first word of
    each text, and the number of words at the end."""

    def __init__(self, column: pa.Array, kind: tuple[np.ndarray, np.ndarray]):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
        self.at = at - at[0]
        keep, value = kind
        self.data, inside = value[raw], keep[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.at[:-1][self.at[:-1] < len(raw)]] = False
        after[self.at[1:][self.at[1:] > 0] - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.n = np.diff(self.first)

    def text(self, i: int) -> str:
        """Word i."""
        return self.data[self.start[i]:self.end[i]].tobytes().decode()

    def hashes(self) -> np.ndarray:
        """64 bits for each word; equal words, equal hashes."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            base = int(self.start[i])
            j = int(np.searchsorted(self.end, base + BLOCK, "right"))
            if j <= i:
                i += 1  # hashed below
                continue
            sums = np.zeros(int(self.end[j - 1]) - base + 1, np.uint64)
            np.cumsum((self.data[base:self.end[j - 1]].astype(np.uint64) + np.uint64(1)) * POWERS[:len(sums) - 1], out=sums[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = mixed((sums[e] - sums[s]) * INVERSES[s] + (e - s).astype(np.uint64))
            i = j
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i]:self.end[i]].tobytes(), 1)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; crosses texts, the caller masks that."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return mixed(out)


class Table:
    """Open addressing from a hash to a small number, whole arrays at a time."""

    def __init__(self, bits: int = 12):
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.bits, self.n = bits, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        slot, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            left, h, slot = left[more], h[more], (slot[more] + 1) & mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """New, distinct hashes other than 0."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old, was = self.keys != 0, self
            old = (self.keys[old], self.values[old])
            was.__init__(max(self.bits + 1, int(2 * (self.n + len(h))).bit_length() + 1))
            self.add(*old)
        self.n += len(h)
        slot, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.values[slot[won]] = values[won]
            lost = ~won
            h, values, slot = h[lost], values[lost], (slot[lost] + 1) & mask
