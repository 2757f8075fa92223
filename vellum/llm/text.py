"""Vectorised word and line tables over a buffer of UTF-8 texts.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). White space is ASCII, so
bytes and code points cut the same words. Words and lines are named by 64-bit polynomial hashes of
their bytes over a table of random 64-bit values, computed for a whole buffer by one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def folded(values: np.ndarray) -> np.ndarray:
    """The table in which A-Z count as a-z."""
    out = values.copy()
    out[65:91] = values[97:123]
    return out


EXACT, LOWER = byte_values(1), folded(byte_values(1))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
KEPT_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n; tables of up to KEPT_POWERS entries are kept between calls."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = n if n > KEPT_POWERS else min(KEPT_POWERS, max(1 << 16, int(n * 1.25)))
    tables = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, dtype=U)
        x[0] = 1
        tables.append(np.cumprod(x, out=x))
    if size <= KEPT_POWERS:
        _powers[:] = tables
    return tables[0], tables[1]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text, or one longer text: (rows, bytes, offsets).

    A null text counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        _, ends, raw = texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, to - row), data[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
            row = to
    pa.default_memory_pool().release_unused()  # a worker goes on to other tasks


class Words:
    """The words of a buffer: start, end (bytes), hash; of document i: those from bounds[i] to bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, values: np.ndarray = EXACT, parted: np.ndarray | None = None):
        """``parted``: further places at which a word ends and another begins."""
        n = len(data)
        self.inside = ~SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        if parted is not None:
            cut[parted] = True
        before, after = cut.copy(), cut.copy()
        before[1:] |= ~self.inside
        after[:-1] |= ~self.inside
        self.start = np.flatnonzero(self.inside & before[:-1])
        self.end = np.flatnonzero(self.inside & after[1:]) + 1
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, dtype=U)
        np.cumsum(values[data] * up[:n], out=self.prefix[1:])
        self.hash = self.spans(self.start, self.end)
        self.bounds = np.searchsorted(self.start, offsets)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(U))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * _BASE + hashes[k : k + m]
    return mix(out)


class HashIndex:
    """An open-addressing map from 64-bit keys to values below 2**31, probed for whole arrays at once; 12 bytes a slot."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, dtype=U), np.zeros(1 << bits, dtype=np.int32)

    @staticmethod
    def _named(keys: np.ndarray) -> np.ndarray:
        return np.where(keys == 0, U(1), keys)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        keys = self._named(keys)
        out = np.full(len(keys), default, dtype=np.int64)
        slot, at, mask = (keys >> U(64 - self.bits)).astype(np.int64), None, (1 << self.bits) - 1
        while len(keys):
            held = self.keys[slot]
            same = held == keys
            found = np.flatnonzero(same)
            out[found if at is None else at[found]] = self.values[slot[found]]
            left = np.flatnonzero(~same & (held != 0))
            at = left if at is None else at[left]
            keys, slot = keys[left], (slot[left] + 1) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the map."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.keys != 0
            kept, grown = (self.keys[old], self.values[old]), HashIndex(max(self.bits + 1, int(2 * (self.size + len(keys))).bit_length()))
            grown.put(*kept)
            self.bits, self.keys, self.values = grown.bits, grown.keys, grown.values
        self.size += len(keys)
        keys, mask = self._named(keys), (1 << self.bits) - 1
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = free & (self.keys[slot] == keys)
            self.values[slot[mine]] = values[mine]
            left = ~mine
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & mask
