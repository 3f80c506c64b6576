"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a block of whole texts. Its words become symbols: one for each word of the
test phrases, and one that stands for any run of other words or the end of a text (no
phrase crosses it). The index is the Burrows-Wheeler transform of the symbols as a
wavelet matrix, the symbol counts, and the suffix positions at every 16th place. All
phrases are searched backwards at once; what occurs is located and merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.words import NON_ALNUM, Block, blocks, byte_table, lean

SHARD_BYTES = 4 << 20
PHRASE_BYTES = 8 << 20
SAMPLE = 16
OTHER = 1


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes in order; ``s`` ends in a 0 that is nowhere else."""
    n = len(s)
    width = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] |= s[i:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    todo, low = order, np.zeros(1, np.int64)  # places whose order is open; rank of the first of them
    sorted_key, where, step = key[order], np.arange(n), width
    while True:
        new = np.ones(len(todo), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.flatnonzero(new)
        rank[todo] = where[group][np.cumsum(new) - 1]
        size = np.diff(np.append(group, len(todo)))
        tied = np.repeat(size > 1, size)
        todo, where = todo[tied], where[tied]
        if not len(todo):
            return order
        key = rank[todo] * (n + 1) + rank[np.minimum(todo + step, n - 1)]
        by = np.argsort(key)
        todo, sorted_key = todo[by], key[by]
        order[where] = todo
        step *= 2


class FMIndex:
    """Backward search and location over one shard; symbols are below ``2**bits``."""

    def __init__(self, s: np.ndarray, bits: int):
        order = suffix_array(s, bits)
        self.size, self.bits = len(s), bits
        count = np.bincount(s, minlength=1 << bits)
        self.before = np.concatenate(([0], np.cumsum(count)[:-1]))
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate(([0], np.cumsum(sampled))).astype(np.int32)
        self.places = order[sampled]
        current = s[order - 1]
        self.zeros, self.n_zeros = [], []
        for bit in range(bits - 1, -1, -1):
            zero = (current >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            current = np.concatenate((current[zero], current[~zero]))
        self.floor = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            zero = (symbol >> (self.bits - 1 - level)) & 1 == 0
            z = self.zeros[level][at]
            at = np.where(zero, z, self.n_zeros[level] + at - z)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each place."""
        return self._down(symbol, at) - self.floor[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one place earlier."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for level in range(self.bits):
            z = self.zeros[level][at]
            zero = self.zeros[level][at + 1] > z
            symbol = symbol * 2 + ~zero
            at = np.where(zero, z, self.n_zeros[level] + at - z)
        return self.before[symbol] + at - self.floor[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase that occurs; phrases end at the last column."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            going = lengths[alive] >= phrases.shape[1] - column
            symbol = phrases[alive, column]
            lo = np.where(going, self.before[symbol] + self.rank(symbol, lo), lo)
            hi = np.where(going, self.before[symbol] + self.rank(symbol, hi), hi)
            found = hi > lo
            alive, lo, hi = alive[found], lo[found], hi[found]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the shard of each row, by steps back to a sampled place."""
        out, steps = np.empty(len(rows), np.int64), 0
        index = np.arange(len(rows))
        while len(rows):
            known = self.sampled[rows + 1] > self.sampled[rows]
            out[index[known]] = self.places[self.sampled[rows[known]]] + steps
            index, rows = index[~known], self.back(rows[~known])
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of some test items, as symbols."""

    table: np.ndarray  # open hash table: place -> number in words, or -1
    words: np.ndarray  # hashes of the words, by number
    windows: np.ndarray  # symbols, right-aligned
    lengths: np.ndarray
    first: np.ndarray  # for each window, where its items begin
    items: np.ndarray  # numbers into names
    names: list[str]

    @property
    def bits(self) -> int:
        return (len(self.words) + 2 - 1).bit_length()

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 + number of each known word, 1 for others."""
        out, mask = np.full(len(hashes), OTHER, np.int64), len(self.table) - 1
        at, open_ = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(open_):
            number = self.table[at]
            open_, at, number = (x[number >= 0] for x in (open_, at, number))
            same = self.words[number] == hashes[open_]
            out[open_[same]] = number[same] + 2
            open_, at = open_[~same], (at[~same] + 1) & mask
        return out


def phrases_of(items: list[tuple[object, str | None]], window: int, table: np.ndarray) -> Phrases | None:
    """Windows of ``window`` words of (id, text) items; a shorter item that has words is one."""
    runs, names = [], []
    for block in blocks(pa.array([t for _, t in items], pa.string()), table, PHRASE_BYTES):
        for row in range(len(block.rows)):
            lo, hi = block.first[row], block.first[row + 1]
            if hi > lo:
                names.append(str(items[block.rows.start + row][0]))
                runs += [(len(names) - 1, block.hashes[i : min(i + window, hi)]) for i in range(lo, max(hi - window, lo) + 1)]
    if not runs:
        return None
    words = np.unique(np.concatenate([h for _, h in runs]))
    size = 1 << max(4, (4 * len(words)).bit_length())
    slots = np.full(size, -1, np.int64)
    for number, h in enumerate(words.tolist()):
        at = h & (size - 1)
        while slots[at] >= 0:
            at = (at + 1) & (size - 1)
        slots[at] = number
    grid = np.zeros((len(runs), window), np.int64)
    for i, (_, h) in enumerate(runs):
        grid[i, window - len(h) :] = np.searchsorted(words, h) + 2
    unique, which = np.unique(grid, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), [item for item, _ in runs]]), axis=1)
    first = np.searchsorted(pairs[0], np.arange(len(unique) + 1))
    return Phrases(slots, words, unique, (unique > 0).sum(1), first, pairs[1], names)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the range of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def shard_hits(block: Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, word after) of each occurrence in the block, and each (row, item) that has one."""
    none = np.zeros(0, np.int64)
    symbol, row = phrases.symbols(block.hashes), block.row_of_word()
    # A run of other words, or of none between two texts, becomes one separator.
    keep = symbol != OTHER
    place = np.flatnonzero(keep)
    if not len(place):
        return none, none, none, none
    gap = np.ones(len(place), bool)
    gap[1:] = (np.diff(place) > 1) | (np.diff(row[place]) > 0)
    to = np.arange(len(place)) + np.cumsum(gap) - 1
    s = np.full(to[-1] + 3, OTHER, np.int64)
    s[to], s[-1] = symbol[place], 0
    origin = np.full(len(s), -1, np.int64)
    origin[to] = place
    index = FMIndex(s, phrases.bits)
    found, lo, hi = index.search(phrases.windows, phrases.lengths)
    rows, which = _ranges(lo, hi)
    start, window = origin[index.locate(rows)], found[which]
    seen = np.unique(np.stack([row[start], window]), axis=1)
    number, pair = _ranges(phrases.first[seen[1]], phrases.first[seen[1] + 1])
    with_item = np.unique(np.stack([seen[0][pair], phrases.items[number]]), axis=1)
    return start, start + phrases.lengths[window], with_item[0], with_item[1]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])
_SCHEMA = "doc_id bigint, text string, n_words bigint, spans array<struct<start:bigint,end:bigint,from_byte:bigint,to_byte:bigint>>, items array<string>"


def _search_batch(batch: pa.RecordBatch, phrases: Phrases, table: np.ndarray) -> pa.RecordBatch:
    earlier = batch.column(3).to_pylist()
    items = batch.column(4).to_pylist()
    n_words, spans = [], []
    for block in blocks(batch.column(1), table, SHARD_BYTES):
        start, end, row, item = shard_hits(block, phrases)
        for i, name in zip(row.tolist(), item.tolist(), strict=True):
            items[block.rows.start + i] = [*items[block.rows.start + i], phrases.names[name]]
        cover = np.zeros(len(block.hashes) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        for i, old in enumerate(earlier[block.rows.start : block.rows.stop]):
            for span in old:
                cover[block.first[i] + span["start"]] += 1
                cover[block.first[i] + span["end"]] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        text_row = block.row_of_word()
        edge = np.ones(len(hit) + 1, bool)  # spans do not go on into the next text
        edge[1:-1] = (hit[1:] != hit[:-1]) | (text_row[1:] != text_row[:-1])
        cut = np.flatnonzero(edge)
        mine: list[list[dict]] = [[] for _ in block.rows]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hit[a]:
                i = int(text_row[a])
                word, byte = int(block.first[i]), int(block.begins[i])
                mine[i].append({"start": a - word, "end": b - word, "from_byte": int(block.starts[a]) - byte, "to_byte": int(block.ends[b - 1]) - byte})
        n_words += block.counts.tolist()
        spans += mine
    arrays = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """``doc_id, text, n_words, spans, items`` of each document.

    ``spans`` are the merged occurrences of the benchmark's windows, in words and in
    bytes of the UTF-8 text; ``items`` the ids of the items they come from, once each.
    NULL texts have no words, NULL items no windows; repeated rows stay repeated, and
    other columns are not carried. The benchmark is read in blocks of ``phrase_bytes``:
    each block's phrases are sent to the tasks, and the blocks follow each other in one
    pass over the documents.
    """
    spark, table = docs.sparkSession, byte_table(NON_ALNUM, lower=True)
    empty = F.lit(None).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,from_byte:bigint,to_byte:bigint>>)").alias("spans")
    out = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *empty, F.expr("cast(array() as array<string>)").alias("items"))

    def searched(df: DataFrame, items: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases_of(items, window, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                if batch.num_rows:
                    yield _search_batch(batch, phrases, table)

        return df.mapInArrow(lean(run), _SCHEMA)

    held, size, passes = [], 0, 0
    for item_id, text in benchmark.select("item_id", F.col("text").cast("string")).filter(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")).toLocalIterator():
        held.append((item_id, text))
        size += len(text)
        if size >= phrase_bytes:
            out, held, size, passes = searched(out, held), [], 0, passes + 1
    if held:
        out, passes = searched(out, held), passes + 1
    if not passes:
        words = F.size(F.filter(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
        return out.withColumn("n_words", words.cast("bigint"))
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Counts and the verdict: at least a twentieth of a document's words in benchmark windows."""
    found = contamination(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
