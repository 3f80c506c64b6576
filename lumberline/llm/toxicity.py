"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are its distinct words (long ones also by their stems), neighbouring
pairs and pairs with one word between, hashed into 2**20 places. The fit sees a bounded sample of labelled rows, one
row at a time, with a learning rate for each coordinate; L1 leaves few weights, which
are sent to the tasks that score all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lumberline.llm.words import NON_ALNUM, Block, blocks, byte_table, lean, mix

BITS = 20
BIAS = 1 << BITS  # the place after the hashed ones
SAMPLE_ROWS = 20_000
EPOCHS = 3
UNTRAINED = -4.0
# Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.1
# Bytes of a longer word that also count as a word of their own: inflected forms share them.
STEMS = (5, 7)
_TABLE = byte_table(NON_ALNUM, lower=True)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each word, stem, pair and skip-pair of a block, with repeats."""
    h, row = block.hashes, block.row_of_word()
    shift, out = np.uint64(64 - BITS), [(row, h >> np.uint64(64 - BITS))]
    for gap in (1, 2):
        inside = row[gap:] == row[:-gap]
        pair = mix(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] ^ (h[gap:] >> np.uint64(29))))
        out.append((row[gap:][inside], (pair >> shift)[inside]))
    folded = _TABLE[block.data]
    for size in STEMS:
        longer = block.ends - block.starts > size
        first, stem = block.starts[longer], np.full(int(longer.sum()), size, np.uint64)
        for i in range(size):
            stem = stem * np.uint64(0x100000001B3) + folded[first + i]
        out.append((row[longer], mix(stem) >> shift))
    return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out]).astype(np.int64)


def _distinct(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << (BITS + 1)) | place)
    return both >> (BITS + 1), both & ((1 << (BITS + 1)) - 1)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> dict[int, float]:
    """Weights that are not 0, by place, after ``epochs`` passes over (distinct places, label)."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(epochs):
        for places, label in rows:
            at = np.append(places, BIAS)
            w = weights(at)
            w[-1] = -z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA)  # no penalty
            error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            square = error * error
            z[at] += error - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    all_ = weights(np.arange(BIAS + 1))
    all_[BIAS] = -z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA) if rows else UNTRAINED
    kept = np.flatnonzero(all_)
    return dict(zip(kept.tolist(), all_[kept].tolist(), strict=True))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that a fit never sees: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """Fit ``labels.toxic`` on at most ``sample_rows`` labelled documents that are not held out.

    The sample is the least ids by a hash. Of several labels of one id the largest counts;
    NULL labels and ids are left out. Without any row all texts score low.
    """
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), _TABLE):
                row, place = _distinct(*features(block))
                offsets = np.searchsorted(row, np.arange(len(block.rows) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
                part = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows += [(i, y, batch.column(2)[k].values.to_numpy().copy()) for k, (i, y) in enumerate(zip(ids, labels, strict=True))]
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[1], len(r[2])))  # a fixed order, mixed
        found = fit([(x, y) for _, y, x in rows])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.float64())], ["place", "weight"])

    # The sample's ids are at most sample_rows; so are the rows that meet in one task for the fit.
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    extracted = sample.select("doc_id", "text", "label").mapInArrow(lean(extract), "doc_id bigint, label int, places array<int>")
    model = extracted.repartition(1).mapInArrow(lean(learn), "place bigint, weight double")
    return dict(map(tuple, model.collect()))  # at most 2**20 + 1 weights


def scored(docs: DataFrame, weights: dict[int, float], name: str = "score") -> DataFrame:
    """Adds ``name`` (0 to 1) from ``text``; NULL and empty texts have the score of no feature.

    All columns and rows stay; a column called ``name`` is replaced.
    """
    docs = docs.drop(name)
    at = docs.columns.index("text")
    places = np.array(sorted(weights), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((places, np.array([weights[p] for p in places.tolist()])))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BIAS + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = [np.zeros(0)]
            for block in blocks(batch.column(at).cast(pa.string()), _TABLE):
                row, place = features(block)
                known = dense[place] != 0
                row, place = _distinct(row[known], place[known])
                total = np.bincount(row, dense[place], minlength=len(block.rows)) + dense[BIAS]
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    found = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, sample_rows))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
