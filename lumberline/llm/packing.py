"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only the number of pieces of each length matters to a packing, and there are at most
``capacity`` lengths. So the driver gets that histogram (4096 numbers, whatever the
input), plans on it, and each piece finds its place from its length and its rank among
the pieces of that length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.ranks import ranked
from lumberline.llm.store import stored
from lumberline.llm.tokens import id_bytes, vocabulary_text
from lumberline.llm.words import lean

RANK_BITS = 44
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """The token ids of each whole text, ``end_id`` after them, cut at every ``capacity`` ids.

    A NULL or empty text is one piece that holds ``end_id`` alone. ``keep_ids`` adds the
    ids (little-endian unsigned 32-bit). Other columns of ``docs`` are not carried;
    repeated rows give repeated pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))
    schema = PIECE + (", ids binary" if keep_ids else "")
    last, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = id_bytes(sent.value)
        look = memo.__getitem__
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = b"".join(map(look, (text or b"").split())) + last
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, crc32(part))
                    rows.append((*row, part) if keep_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = zip(*rows, strict=True) if rows else [[]] * (5 + keep_ids)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(cut), schema)


class _Gaps:
    """Lengths still to be placed, and the index of what exactly fills a gap."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.sums = None  # which sums two present lengths have; may name some that are used up by now

    def times(self, members: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // n for x, n in Counter(members).items())

    def take(self, members: tuple[int, ...]) -> int:
        n = self.times(members)
        for x in members:
            self.left[x] -= n
        return n

    def singles(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.left[gap]:
            yield (gap,)

    def pairs(self, gap: int) -> Iterator[tuple[int, ...]]:
        have = self.left[: gap + 1] > 0
        for a in np.flatnonzero(have & have[::-1])[::-1]:
            if 2 * a < gap:
                break
            if a < gap:
                yield (int(a), gap - int(a))

    def triples(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.sums is None:
            spectrum = np.fft.rfft((self.left > 0).astype(float), 2 * len(self.left))
            self.sums = np.fft.irfft(spectrum * spectrum)[: self.capacity + 1] > 0.5
        have = self.left[: gap + 1] > 0
        for a in np.flatnonzero(have & self.sums[gap::-1])[::-1]:
            if 3 * a < gap:
                break
            for pair in self.pairs(gap - int(a)):
                if self.left[a] and pair[0] <= a:
                    yield (int(a), *pair)
                    break

    def fill(self, big: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Sequences that begin with ``big`` and have no gap, and how many of each."""
        gap = self.capacity - big
        self.sums = None
        for find in (self.singles, self.pairs, self.triples):
            found = True
            while found and self.left[big]:
                found = False
                for combination in find(gap):
                    members = (big, *combination)
                    if self.times(members):
                        yield members, self.take(members)
                        found = True
                        break


def plan_packing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences) for a histogram of lengths.

    From the longest down, each length takes the one, two or three lengths whose sum is
    exactly what it leaves free, as often as there are enough of them. What stays is
    packed best-fit, longest first, equal lengths and equal gaps at a time.
    """
    gaps = _Gaps(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    if gaps.left[capacity]:
        out.append(((capacity,), int(gaps.left[capacity])))
        gaps.left[capacity] = 0
    for big in range(capacity - 1, 0, -1):
        if gaps.left[big]:
            out += gaps.fill(big)
    bins: defaultdict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    is_open = np.zeros(capacity + 1, bool)

    def put(members: tuple[int, ...], number: int, gap: int) -> None:
        if number:
            bins[gap].append((members, number))
            is_open[gap] = True

    for size in range(capacity - 1, 0, -1):
        todo = int(gaps.left[size])
        while todo:
            gap = size + int(is_open[size:].argmax())
            if not is_open[gap]:
                gap, members, number = capacity, (), todo  # as many new sequences as it takes
            else:
                members, number = bins[gap].pop()
                is_open[gap] = bool(bins[gap])
            each = gap // size
            full = min(number, todo // each)
            put(members + (size,) * each, full, gap - each * size)
            todo -= full * each
            number -= full
            if number and todo:
                put(members + (size,) * todo, 1, gap - todo * size)
                number, todo = number - 1, 0
            if members:
                put(members, number, gap)
    return out + [x for of_gap in bins.values() for x in of_gap]


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the ranks of each length begin to go: (length and rank, sequence, rank, offset)."""
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for members, number in plan:
        offset = 0
        for x in members:
            rows.append(((x << RANK_BITS) + int(used[x]), sequence, int(used[x]), offset))
            used[x] += number
            offset += x
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def pack(pieces: DataFrame, order: list[str], capacity: int = 4096, rows_per_group: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    ``order`` names columns that tell pieces apart; equal ones may change places. Pieces
    of one length are ranked in salted groups of about ``rows_per_group`` rows, so a
    length that a third of all pieces share is not one task's work. An empty table gives
    an empty table. The plan sent to the tasks has a few rows for each possible length.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[length] = n
    if counts[0] or int(counts.sum()) >> RANK_BITS:
        raise ValueError("a piece has a length from 1 to the capacity, and there are fewer than 2**44")
    keys, sequence, rank, offset = _places(plan_packing(counts, capacity), capacity)
    sent = spark.sparkContext.broadcast((keys, sequence, rank, offset))

    salts = max(1, -(-int(counts.sum()) // rows_per_group))
    ordered = ranked(pieces, ["length"], [F.col(c) for c in order], salts, "_rank")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        keys, sequence, rank, offset = sent.value
        at = at.to_numpy(np.int64)
        i = np.searchsorted(keys, (length.to_numpy(np.int64) << RANK_BITS) + at, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[i] + at - rank[i], "offset": offset[i]})

    placed = ordered.withColumn("_place", place(F.col("length"), F.col("_rank")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Texts to token pieces to packed sequences; see :func:`token_pieces` and :func:`pack`."""
    pieces = stored(token_pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
