"""Words of whole texts as numpy arrays, for operators that read Arrow batches.

A batch is cut into blocks of about a megabyte of text. In a block every word gets a
64-bit hash of its bytes, and every run of words a hash of its word hashes, from two
running sums; no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
USUAL_POWERS = BLOCK_BYTES + (1 << 16)  # a block's bytes and one more for each of its rows
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte becomes: 0 for a separator, else itself (256 for a NUL), A-Z in lower case if asked."""
    out = np.arange(256, dtype=np.uint16)
    out[0] = 256
    if lower:
        out[ord("A") : ord("Z") + 1] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out if out[0] else out.astype(np.uint8)


# The separators of the two word rules.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving freed memory back to the system at the end of each task.

    Python workers stay for later tasks; what their allocators hoard counts against the
    executor, together with what the next stage needs.
    """

    def to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return to_end


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size."""
    def run(step: int) -> np.ndarray:
        out = np.empty(size, np.uint64)
        out[0], have = 1, 1
        while have < size:
            more = min(have, size - have)
            out[have : have + more] = out[:more] * np.uint64(pow(step, have, 1 << 64))
            have += more
        return out

    return run(base), run(pow(base, -1, 1 << 64))


@cache
def _usual_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, USUAL_POWERS)


def _up_to(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for at least ``size``: those of usual blocks are kept, those of longer texts made anew."""
    return _usual_powers(base) if size <= USUAL_POWERS else _powers(base, size)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Words of some rows; row numbers count from the start of the Arrow batch."""

    rows: range
    data: np.ndarray  # bytes as they came, one space after each text
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray
    first: np.ndarray  # for each row, and once past the last, the number of its first word
    begins: np.ndarray  # first byte of each row, and once past the last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that begin a run of k words of one row, and the runs' hashes."""
        counts = self.counts
        n = len(self.hashes)
        power, inverse = _up_to(_WORD_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * power[:n], out=total[1:])
        left = np.repeat(self.first[1:], counts) - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, mix((total[at + k] - total[at]) * inverse[at])

    def whole(self) -> np.ndarray:
        """A hash of all words of each row."""
        n = len(self.hashes)
        power, inverse = _up_to(_WORD_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * power[:n], out=total[1:])
        a, b = self.first[:-1], self.first[1:]
        return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; NULL is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets.astype(np.int64)


def spans_of_rows(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[range]:
    """Ranges of rows that hold at most ``limit`` bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield range(at, to)
        at = to


def blocks(texts: pa.Array, table: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The words of a string column, block by block, in the order of its rows."""
    if not len(texts):
        return
    data, offsets = text_bytes(texts)
    for rows in spans_of_rows(offsets, limit):
        lo, hi = rows.start, rows.stop
        begin = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
        buf = np.full(int(begin[-1]), 0x20, np.uint8)
        for i in range(hi - lo):
            buf[begin[i] : begin[i + 1] - 1] = data[offsets[lo + i] : offsets[lo + i + 1]]
        seen = table[buf]
        in_word = np.zeros(len(buf) + 2, np.int8)
        in_word[1:-1] = seen != 0
        step = np.diff(in_word)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        power, inverse = _up_to(_BYTE_BASE, len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(seen * power[: len(buf)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        yield Block(rows, buf, starts, ends, hashes, np.searchsorted(starts, begin), begin)
