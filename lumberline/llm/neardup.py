"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has chunks of components of 16 bits. Two signatures of c chunks that differ
in at most 2c - 1 components differ in at most one component of one chunk (pigeonhole),
so they agree on one of the keys made of a chunk with one component left out. All such
pairs are candidates, without exception. The number and width of the chunks follow the
percentage to link from (``layout``): at 85, 8 chunks of 4, and a pair at exactly this
similarity differs in 16 or more components with a probability of 3.5e-6. Candidates
whose one-bit sketches of 1024 more minima are too far apart for a link (in the join's
own condition, so they never become rows) are left out; links are confirmed on the full
shingle sets of the texts.

Documents with equal sets are one class from the start. To avoid the pairs within a
group, each class is first compared with the largest class of its buckets; only what a
bucket still has in different components is compared with the rest of the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.store import stored
from lumberline.llm.words import SPACES, Block, blocks, byte_table, lean, mix

SKETCH_BITS = 1024
SHINGLE = 5
# How often a pair at exactly the least similarity may be missed by the keys, and by the sketches.
KEY_MISS, SKETCH_MISS = 1e-5, 2.5e-7
MANY_CHUNKS = 24  # from here on narrower chunks are tried, which need fewer


def _most(n: int, p: float, miss: float) -> int:
    """The least number of successes of ``n`` that is exceeded with a probability of at most ``miss``."""
    beyond, k = 0.0, n
    while p > 0 and k > 0:
        beyond += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if beyond > miss:
            return k
        k -= 1
    return 0


@dataclass(frozen=True)
class Layout:
    chunks: int
    width: int
    sketch_distance: int

    @property
    def components(self) -> int:
        return self.chunks * self.width


@cache
def layout(percent: int) -> Layout:
    """The chunks and the sketch distance that find pairs from a similarity of ``percent`` on."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100: {percent}")
    apart = 1 - percent / 100
    # Sketch bits differ with a probability of half the dissimilarity.
    near = _most(SKETCH_BITS, apart / 2, SKETCH_MISS)
    for width in (4, 3):
        for chunks in range(1, MANY_CHUNKS):
            if _most(width * chunks, apart, KEY_MISS) <= 2 * chunks - 1:
                return Layout(chunks, width, near)
    # Of two components one may differ: a pair is missed only if all of them differ.
    return Layout(max(1, math.ceil(math.log(KEY_MISS) / math.log(apart) / 2)), 2, near)


def _sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of each row, in order."""
    at, run = block.runs(k)
    row = block.row_of_word()[at] if len(at) else at
    short = np.flatnonzero((block.counts > 0) & (block.counts < k))
    row, run = np.concatenate((row, short)), np.concatenate((run, block.whole()[short]))
    order = np.lexsort((run, row))
    row, run = row[order], run[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
    return row[new], run[new]


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, n)


def signatures(docs: DataFrame, components: int, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature``; a text without words has an empty set.

    ``set_a`` and ``set_b`` are order-free 64-bit sums over the set, so texts with the
    same three values have the same set (but for a chance of 2**-128 a pair).
    """
    table, (odd, add) = byte_table(SPACES, lower=True), _factors(components)
    odd = odd | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, signs = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.uint64)], [np.zeros((0, components), np.int32)]
            for block in blocks(batch.column(1), table):
                row, run = _sets(block, k)
                n = np.bincount(row, minlength=len(block.rows))
                has = np.flatnonzero(n)
                first = np.concatenate(([0], np.cumsum(n)))[has]
                sign = np.zeros((len(n), components), np.int32)
                both = np.zeros((2, len(n)), np.uint64)
                if len(has):
                    both[0, has] = np.add.reduceat(mix(run), first)
                    both[1, has] = np.add.reduceat(mix(run ^ add[0]), first)
                    for j in range(components):
                        least = np.minimum.reduceat(run * odd[j] + add[j], first)
                        sign[has, j] = (mix(least) >> np.uint64(48)).astype(np.int32)
                sizes.append(n)
                sums.append(both)
                signs.append(sign)
            n, both, sign = np.concatenate(sizes), np.concatenate(sums, axis=1).view(np.int64), np.concatenate(signs)
            offsets = pa.array(np.arange(len(n) + 1) * components, pa.int32())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(both[0]), pa.array(both[1]), pa.ListArray.from_arrays(offsets, pa.array(sign.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return picked.mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<int>")


def sketched(docs: DataFrame, components: int, k: int = SHINGLE) -> DataFrame:
    """Adds ``sketch`` to (doc_id, text): the lowest bits of 1024 further minima, as 16 numbers."""
    table, (odd, add) = byte_table(SPACES, lower=True), _factors(components + SKETCH_BITS)[:, components:]
    odd, top = odd | np.uint64(1), np.uint64(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, SKETCH_BITS // 64), np.uint64)]
            for block in blocks(batch.column(1), table):
                row, run = _sets(block, k)
                n = np.bincount(row, minlength=len(block.rows))
                has = np.flatnonzero(n)
                first = np.concatenate(([0], np.cumsum(n)))[has]
                out = np.zeros((len(n), SKETCH_BITS // 64), np.uint64)
                for j in range(SKETCH_BITS if len(has) else 0):
                    least = np.minimum.reduceat(run * odd[j] + add[j], first)
                    out[has, j // 64] |= (mix(least) >> top) << np.uint64(j % 64)
                parts.append(out)
            flat = np.concatenate(parts).view(np.int64)
            offsets = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["doc_id", "text", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, text string, sketch array<bigint>")


def sketches_near(a: str, b: str, distance: int) -> F.Column:
    """Whether two sketches differ in at most ``distance`` bits."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(bits[1:], bits[0]) <= distance


def bucket_keys(plan: Layout, signature: str = "signature") -> F.Column:
    """The keys of a signature: each chunk with each of its components left out."""
    at = lambda i: F.col(signature)[i]
    keys = [
        F.xxhash64(F.lit(chunk * plan.width + out), *[at(chunk * plan.width + i) for i in range(plan.width) if i != out])
        for chunk in range(plan.chunks) for out in range(plan.width)
    ]
    return F.array(*keys)


def first_shared(plan: Layout, bucket: str, a: str, b: str) -> F.Column:
    """Whether a bucket is the first that two signatures share, so that a pair is met once."""
    width = plan.width
    number, out = F.floor(F.col(bucket) / width), F.col(bucket) % width
    earlier = F.lit(False)
    for chunk in range(plan.chunks):
        same = [(F.col(a)[chunk * width + i] == F.col(b)[chunk * width + i]).cast("int") for i in range(width)]
        alike = sum(same[1:], same[0])
        earlier |= ((number > chunk) & (alike >= width - 1)) | ((number == chunk) & (alike == width) & (out > 0))
    return ~earlier


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """The (a, b) pairs whose full shingle sets have ``100 * intersection >= percent * union``."""
    table = byte_table(SPACES, lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                found = [(row + block.rows.start, run) for block in blocks(column, table) for row, run in [_sets(block, k)]]
                sides.append([np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.uint64))])
            n = [np.bincount(row, minlength=batch.num_rows) for row, _ in sides]
            row, run = (np.concatenate((sides[0][i], sides[1][i])) for i in (0, 1))
            order = np.lexsort((run, row))
            row, run = row[order], run[order]
            same = (row[1:] == row[:-1]) & (run[1:] == run[:-1])
            both = np.bincount(row[1:][same], minlength=batch.num_rows)
            linked = (both > 0) & (100 * both >= percent * (n[0] + n[1] - both))
            yield batch.select([0, 1]).filter(pa.array(linked))

    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    whole = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the least node that each node of (a, b) links can reach.

    Alternates two steps until nothing changes: every node's larger neighbours are linked
    to its least neighbour, then its smaller ones. Links stay as many as they were.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")

    def shape(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = shape(now)
    for _ in range(rounds):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ways = [F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("u", "v")]
        small = large.join(least, "u").select(F.inline(F.array(*ways))).filter("u != v").distinct()
        now = stored(small, "links")
        before, state = state, shape(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked from a similarity of ``percent`` on; a component is named by its
    least ``doc_id``, which alone is kept. Texts without words and NULL texts are linked
    with nothing; rows with a NULL id get a NULL component and are kept. Rows that share
    a ``doc_id`` are one document. Other columns are not carried.
    """
    plan = layout(percent)
    signed = stored(signatures(docs, plan.components, k), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = stored(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")),
        "classes",
    )
    keyed = classes.select("rep", "n_shingles", "copies", F.posexplode(bucket_keys(plan)).alias("bucket", "key"))
    top = F.max(F.struct("copies", (-F.col("rep")).alias("rep"), "n_shingles"))
    shared = keyed.groupBy("key").agg(top.alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = stored(keyed.drop("copies").join(shared, "key").select("bucket", "key", "rep", "n_shingles", (-F.col("top.rep")).alias("leader"), F.col("top.n_shingles").alias("leader_n")), "buckets")
    near_size = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(F.col(a), F.col(b))

    members = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(members, "doc_id", "left_semi")
    texts = stored(sketched(texts, plan.components, k), "texts")
    sketches = texts.select(F.col("doc_id").alias("rep"), "sketch").dropDuplicates(["rep"])
    texts = texts.drop("sketch")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = sketches.withColumnsRenamed({"rep": "a", "sketch": "sa"}), sketches.withColumnsRenamed({"rep": "b", "sketch": "sb"})
        return pairs.join(a, "a").join(b, "b").filter(sketches_near("sa", "sb", plan.sketch_distance)).select("a", "b")

    # Each class against the leaders it shares most buckets with.
    star = buckets.filter("rep != leader").filter(near_size("n_shingles", "leader_n")).groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"))
    best = star.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).filter("i <= 2").select("a", "b")
    links = stored(confirmed(near(best), texts, percent, k), "confirmed")
    roots = stored(components(links), "roots")

    # What is still apart in a bucket: all but its largest component, against the whole bucket.
    labelled = buckets.join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "key", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    per_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = per_root.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    open_ = stored(labelled.join(main, "key").join(sketches, "rep").join(classes.select("rep", "signature"), "rep"), "open")
    others = open_.filter("root != main").select("key", F.col("rep").alias("x"), F.col("root").alias("rx"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("sx"), "bucket", F.col("signature").alias("gx"))
    rest = open_.select("key", "main", F.col("rep").alias("y"), F.col("root").alias("ry"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("sy"), F.col("signature").alias("gy"))
    # A pair of others is met from both sides: once is enough.
    once = (F.col("ry") == F.col("main")) | (F.col("x") < F.col("y"))
    met = (F.col("rx") != F.col("ry")) & once & near_size("nx", "ny") & sketches_near("sx", "sy", plan.sketch_distance) & first_shared(plan, "bucket", "gx", "gy")
    apart = others.join(rest, "key").filter(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = confirmed(apart, texts, percent, k)
    roots = components(links.unionByName(more))

    rooted = classes.join(roots, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("root", "rep").alias("_root"))
    out = signed.join(rooted, same, "left")
    # A doc_id on several rows, with different texts, is one document: it has one component.
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_root", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
