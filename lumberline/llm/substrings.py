"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: the least of 16 neighbouring runs of 5 words. Every window
of 20 words holds exactly 16 such runs, so equal windows have the same anchor at the
same place in them, and only texts that share an anchor need be compared. An anchor is
extended both ways over the windows that it stands for. Occurrences of an anchor whose
whole extent is the same form a class: all but the first are repeats from end to end,
and only the firsts of different classes are compared window by window. Neighbouring
repeated windows join into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.store import stored
from lumberline.llm.words import SPACES, Block, blocks, byte_table, lean, mix

SEED = 5


def _winnow(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, their hashes, the place of each one's anchor, and all run hashes."""
    start, whole = block.runs(window)
    at, run = block.runs(SEED)
    n, width = len(block.hashes), window - SEED + 1
    dense = np.zeros(n, np.uint64)
    dense[at] = run
    key = np.full(n + window, ~np.uint64(0))
    key[at] = run
    place, span = np.arange(n + window), 1
    while span < width:
        by = min(span, width - span)
        later = key[by:] <= key[:-by]  # of equal ones the last
        key, place = np.where(later, key[by:], key[:-by]), np.where(later, place[by:], place[:-by])
        span += by
    return start, whole, place[start], dense


def _extents(block: Block, window: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its place, hash, first window, number of windows, and a hash of its whole extent."""
    start, whole, anchor, dense = _winnow(block, window)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    place = np.arange(len(start)) - np.repeat(first, size)
    extent = np.add.reduceat(mix(whole ^ (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return anchor[first], dense[anchor[first]], start[first], size, extent


_OUT = ["part", "seed", "extent", "doc_id", "at", "lead", "size"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()]


def seeds(docs: DataFrame, window: int) -> DataFrame:
    """``part, seed, extent, doc_id, at, lead, size`` of each anchor.

    Of equal extents within one block all but the first are sent to their document
    (``seed`` NULL, ``part`` from the id), so that a hot passage meets as one row a block.
    """
    table = byte_table(SPACES, lower=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1), table):
                anchor, seed, first, size, extent = _extents(block, window)
                row = block.row_of_word()[anchor] if len(anchor) else anchor
                doc = ids[block.rows.start + row]
                at, lead = anchor - block.first[row], anchor - first
                order = np.lexsort((at, doc, extent, seed))
                doc, at, lead, size, seed, extent = (x[order] for x in (doc, at, lead, size, seed, extent))
                again = np.zeros(len(at), bool)
                again[1:] = (seed[1:] == seed[:-1]) & (extent[1:] == extent[:-1])
                # Rows of one doc_id are one document: not later than each other at the same place.
                again[1:] &= (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
                seed, extent = seed.astype(np.uint64).view(np.int64), extent.astype(np.uint64).view(np.int64)
                part = np.where(again, mix(doc.astype(np.uint64)).view(np.int64), seed)
                arrays = [part, pa.array(seed, mask=again), extent, doc, at, lead, size]
                yield pa.RecordBatch.from_arrays([pa.array(a).cast(t) for a, t in zip(arrays, _KINDS, strict=True)], _OUT)

    return docs.mapInArrow(lean(run), "part bigint, seed bigint, extent bigint, doc_id bigint, at int, lead smallint, size smallint")


def _asked_windows(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """``seed, hash, doc_id, start`` of the windows of the asked-for anchors of each document."""
    table = byte_table(SPACES, lower=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_numpy(), batch.column(2)
            for block in blocks(batch.column(1), table):
                start, whole, anchor, dense = _winnow(block, window)
                wanted = np.zeros(len(block.hashes) + 1, bool)
                for i, row in enumerate(block.rows):
                    places = block.first[i] + asked[row].values.to_numpy()
                    wanted[places[places < block.first[i + 1]]] = True
                pick = wanted[anchor] if len(anchor) else np.zeros(0, bool)
                start, whole, anchor = start[pick], whole[pick], anchor[pick]
                row = block.row_of_word()[start] if len(start) else start
                arrays = [dense[anchor].view(np.int64), whole.view(np.int64), ids[block.rows.start + row], (start - block.first[row]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["seed", "hash", "doc_id", "start"])

    per_doc = asked.groupBy("doc_id").agg(F.collect_set("at").alias("asked"))  # a document's own anchors
    return docs.join(per_doc, "doc_id").select("doc_id", "text", "asked").mapInArrow(lean(run), "seed bigint, hash bigint, doc_id bigint, start int")


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, start, end``: words of windows that also start earlier; spans may overlap.

    ``docs`` has ``doc_id`` (not NULL) and ``text``. Earlier is a smaller ``doc_id``, or
    an earlier word of the same document.
    """
    # One exchange and one sort: the first of each extent, and whether its seed has several.
    dealt = seeds(docs, window).repartition("part")
    here = F.struct("doc_id", "at")
    of_seed = Window.partitionBy("part", "seed")
    judged = dealt.withColumns({
        "first": F.min(here).over(Window.partitionBy("part", "seed", "extent")),
        "several": F.min("extent").over(of_seed) != F.max("extent").over(of_seed),
    })
    repeated = F.col("seed").isNull() | (here > F.col("first"))
    judged = stored(judged.select("doc_id", "at", "lead", "size", repeated.alias("repeated"), "several").filter("repeated or several"), "anchors")
    whole = judged.filter("repeated").select("doc_id", (F.col("at") - F.col("lead")).alias("start"), "size")
    windows = _asked_windows(docs, judged.filter("not repeated"), window)
    place = F.struct("doc_id", "start")
    windows = windows.withColumn("first", F.min(place).over(Window.partitionBy("seed", "hash")))
    single = windows.filter(place > F.col("first")).select("doc_id", "start", F.lit(1).alias("size"))
    spans = whole.unionByName(single)
    return spans.select("doc_id", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size") + window - 1).cast("int").alias("end"))


def without_repeats(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept`` words) of every row of ``docs``.

    A word goes if a window of ``window`` consecutive words that covers it also starts
    earlier. NULL and empty texts have no words; rows with a NULL id are left whole and
    are earlier than nothing. Rows of one ``doc_id`` are one document, and should have
    one text. Other columns are not carried.
    """
    table = byte_table(SPACES, lower=False)
    picked = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = picked.filter("doc_id is not null")
    spans = repeats(known, window).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            spans = batch.column(2)
            for block in blocks(batch.column(1), table):
                n = len(block.hashes)
                cover = np.zeros(n + 1, np.int64)
                for i, row in enumerate(block.rows):
                    if spans[row].is_valid:
                        own, count = spans[row].values, block.first[i + 1] - block.first[i]
                        np.add.at(cover, block.first[i] + np.minimum(own.field("start").to_numpy(), count), 1)
                        np.add.at(cover, block.first[i] + np.minimum(own.field("end").to_numpy(), count), -1)
                gone = np.cumsum(cover[:-1]) > 0
                lost = np.concatenate(([0], np.cumsum(gone)))[block.first]
                n_words.append(block.counts)
                n_removed.append(np.diff(lost))
                # Kept words with one space after each; the last one's is left off below.
                keep = np.zeros(len(block.data) + 1, np.int8)
                np.add.at(keep, block.starts[~gone], 1)
                np.add.at(keep, block.ends[~gone] + 1, -1)
                keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
                data = block.data.copy()
                data[block.ends] = 0x20
                out, edge = data[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[block.begins].tolist()
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    text = out[a : max(a, b - 1)]
                    digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        kept.append(text.decode())
            arrays = [batch.column(0), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_words, n_removed)), pa.array(digests, pa.string())]
            arrays += [pa.array(kept, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    judged = known.join(spans, "doc_id", "left")
    unplaced = picked.filter("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return judged.unionByName(unplaced).mapInArrow(lean(run), schema)
