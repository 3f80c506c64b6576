"""Fill-in-middle transformation; cut places come from a compressed set of unit boundaries.

The boundaries of a text's units are kept as a set of positions in containers of 2**16
positions each: a sorted array, a bitmap or a list of runs, whichever is smallest. With
the cumulative cardinalities of the containers, the k-th boundary is one search for the
container and one selection inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.words import lean

CHUNK = 1 << 16
FLUSH_CHARS = 1 << 22  # characters of output in one Arrow batch, or one text
SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class ArrayContainer:
    """Few positions: a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    @staticmethod
    def size(values: np.ndarray) -> int:
        return 2 * len(values)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """Many positions: one bit each, with the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def size(values: np.ndarray) -> int:
        return CHUNK // 8

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[i])
        for _ in range(k - int(self.before[i])):
            word &= word - 1
        return 64 * i + (word & -word).bit_length() - 1


class RunContainer:
    """Long stretches of positions: the first of each, with the number of positions before each."""

    def __init__(self, values: np.ndarray):
        first = np.flatnonzero(np.diff(values, prepend=values[0] - 2) != 1)
        self.starts, self.before = values[first], first

    @staticmethod
    def size(values: np.ndarray) -> int:
        return 4 * (1 + int(np.count_nonzero(np.diff(values) != 1)))

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[i]) + k - int(self.before[i])


class BoundarySet:
    """A set of positions (ascending, distinct, from 0 on) that gives its k-th member."""

    def __init__(self, positions: np.ndarray):
        keys, first = np.unique(positions // CHUNK, return_index=True)
        self.keys, self.before = keys, np.append(first, len(positions))
        self.containers = []
        for key, a, b in zip(keys, first, self.before[1:], strict=True):
            values = positions[a:b] - key * CHUNK
            kind = min((ArrayContainer, RunContainer, BitmapContainer), key=lambda c: c.size(values))
            self.containers.append(kind(values))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.keys[i]) * CHUNK + self.containers[i].select(k - int(self.before[i]))


def unit_ends(text: str, unit: str = "words") -> np.ndarray:
    """The place (in code points) behind each unit of a text, after 0.

    ``words`` are runs of non-spaces with the spaces before them, and the spaces at the
    end; ``characters`` are single code points. Spaces are U+0020 and U+0009 to U+000D.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if unit == "characters":
        return np.arange(len(points) + 1)
    if unit != "words":
        raise ValueError(f"unknown unit {unit!r}")
    word = (points != 0x20) & (points - np.uint32(9) > 4)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = np.flatnonzero(last) + 1
    rest = [len(points)] if len(points) and not word[-1] else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit draws of one document; a NULL id is written as nothing."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def fill_in_middle(
    docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
    unit: str = "words", sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each whole text.

    A share of the texts is cut at two drawn unit boundaries and written as prefix, suffix,
    middle (``psm``) or suffix, prefix, middle (``spm``), each behind its sentinel; the
    others stay ``plain``, as do empty texts (a NULL text is empty) and texts that contain
    a sentinel. ``n`` counts units, the ``_chars`` code points (NULL for plain).
    Draws depend on ``seed`` and ``doc_id`` alone, so repeated rows give equal rows. Other
    columns are not carried; an empty table gives an empty table. A text is held whole in
    one task, as any row is.
    """
    if len(set(sentinels)) < 3 or any(a[i:] and b.startswith(a[i:]) for a in sentinels for b in sentinels for i in range(1, len(a))):
        raise ValueError("sentinels differ, and none begins as another ends")
    p, s, m = sentinels

    def one(doc_id: int | None, text: str) -> tuple:
        ends = unit_ends(text, unit)
        n = len(ends) - 1
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= fim_percent or any(x in text for x in sentinels):
            return doc_id, n, "plain", None, None, text
        found = BoundarySet(ends)
        a, b = (found.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return doc_id, n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return doc_id, n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(one(doc_id.as_py(), text.as_py() or ""))
                held += len(rows[-1][-1])
                if held >= FLUSH_CHARS:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was transformed into ``output``; NULL where either is NULL or the form is unknown.

    The parts hold no sentinel, so each sentinel's first place is its own.
    """
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    p, s, m = sentinels
    parts = [F.split_part(output, F.lit(x), F.lit(2)) for x in sentinels]  # what is behind each sentinel
    prefix, suffix, middle = parts
    before_m = lambda part: F.split_part(part, F.lit(m), F.lit(1))
    psm = F.concat(F.split_part(prefix, F.lit(s), F.lit(1)), middle, before_m(suffix))
    spm = F.concat(before_m(prefix), middle, F.split_part(suffix, F.lit(p), F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
