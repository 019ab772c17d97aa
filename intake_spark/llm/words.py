"""Words and their hashes for whole Arrow string columns, in NumPy, without a Python object per word.

A block is a run of neighbouring rows whose texts together hold about ``BLOCK`` bytes (a longer text is a
block of its own), so memory is bounded by the longest text and not by the size of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A mask over the 256 bytes that is False inside the given ranges (ends included)."""
    mask = np.ones(256, bool)
    for lo, hi in ranges:
        mask[lo:hi + 1] = False
    return mask


#: [^\x20\x09-\x0D]
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n >> 16 << 16) if n > BLOCK else BLOCK + 1
            step = np.full(size, self.base, U64)
            step[0] = 1
            up = np.multiply.accumulate(step)
            step[1:] = U64(self.inverse)
            down = np.multiply.accumulate(step)
            if size > 3 * BLOCK:  # a giant text must not stay in memory
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WORDS = _Powers(0xD1342543DE82EF95)


def _byte_values(seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(b"%d:%d" % (seed, i)).digest()[:8] for i in range(256)), "<u8").astype(U64)


_VALUES = {seed: _byte_values(seed) for seed in (1, 2)}


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial from prefix sums, shifted back to power 0."""
    up, down = _BYTES.get(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_VALUES[seed][data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` neighbouring words; ``len(words) - n + 1`` of them."""
    if len(words) < n:
        return np.empty(0, U64)
    up, down = _WORDS.get(len(words) + 1)
    sums = np.empty(len(words) + 1, U64)
    sums[0] = 0
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:len(words) - n + 1])


@dataclass
class Block:
    """Neighbouring rows: their bytes, word ranges, and for each row its first and last-plus-one word."""

    first_row: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def hashes(self, seed: int = 1) -> np.ndarray:
        return segment_hash(self.data, self.start, self.end, seed)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.last - self.first)


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, word_bytes: np.ndarray = SPACED, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    data, offsets = _string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, n)
        part = data[offsets[row]:offsets[stop]]
        if lower:
            part = LOWER[part]
        ends = offsets[row:stop + 1] - offsets[row]
        mask = word_bytes[part]
        before = np.empty(len(part), bool)
        before[1:] = mask[:-1]
        before[:1] = False
        edges = ends[:-1][ends[:-1] < len(part)]
        before[edges] = False  # a word never runs on into the next text
        start = np.flatnonzero(mask & ~before)
        after = np.empty(len(part), bool)
        after[:-1] = mask[1:]
        after[-1:] = False
        inner = ends[1:][ends[1:] > 0]
        after[inner - 1] = False
        end = np.flatnonzero(mask & ~after) + 1
        yield Block(row, stop - row, part, ends, start, end,
                    np.searchsorted(start, ends[:-1], "left"), np.searchsorted(start, ends[1:], "left"))
        row = stop


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The given words joined by one space."""
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist())])


def segment_hash_of(block: Block, which: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of some words of a block; the byte ranges are gathered first, so that few words cost little."""
    size = block.end[which] - block.start[which]
    end = np.cumsum(size)
    start = end - size
    data = block.data[np.arange(int(size.sum())) - np.repeat(start, size) + np.repeat(block.start[which], size)]
    return segment_hash(data, start, end, seed)
