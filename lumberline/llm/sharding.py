"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in local partitions (by a keyed hash). How many rows each partition sends to
each shard is drawn first: given the shards' free places, a partition's counts are
multivariate hypergeometric. Rows are permuted within their partition and dealt out by
these counts, and permuted again within their shard.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumberline.llm.ranks import ranked
from lumberline.llm.store import stored

NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items are good, without replacement, for counts of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    mean = drawn * good / (good + bad)
    spread = 40 * (1 + (mean * (1 - good / (good + bad))) ** 0.5)  # beyond it the chance is below 1e-300
    low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=float)
    log = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1))))
    cumulated = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(cumulated, rng.random() * cumulated[-1], side="right"))


def communication_matrix(rows: list[int], places: list[int], seed: int) -> list[list[int]]:
    """For each partition, the rows it sends to each shard; both margins are exact."""
    rng, free, out = np.random.default_rng(seed), list(places), []
    for n in rows:
        sent, rest = [], sum(free)
        for s, f in enumerate(free):
            rest -= f
            x = hypergeometric(rng, f, rest, n)
            sent.append(x)
            free[s] -= x
            n -= x
        out.append(sent)
    return out


def shuffled_into_shards(
    df: DataFrame, keys: list[str], shards: int = 40, seed: int = 17, partitions: int = 1024, rows_per_group: int = 100_000
) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most, the first shards having the larger size.
    ``keys`` tell rows apart and with ``seed`` decide everything; equal rows take the
    places of their group in any order. The driver gets one count for each of the
    ``partitions``, a parameter that does not follow the input. An empty table gives an
    empty table; columns called shard or slot are replaced.
    """
    spark = df.sparkSession

    def keyed(step: int) -> F.Column:
        return F.xxhash64(F.lit(seed), F.lit(step), *keys)

    local = df.drop("shard", "slot").withColumn("_part", F.pmod(keyed(0), F.lit(partitions)).cast("int"))
    counts = {r["_part"]: r["count"] for r in local.groupBy("_part").count().collect()}
    parts, total = sorted(counts), sum(counts.values())
    places = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in parts], places, seed)
    ends = [{"_part": p, "_ends": np.cumsum(row).tolist()} for p, row in zip(parts, matrix, strict=True)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<_part:int,_ends:array<bigint>>>")))

    first = Window.partitionBy("_part").orderBy(keyed(1), *keys)
    dealt = local.withColumn("_at", F.row_number().over(first) - 1).join(table, "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_at")))).drop("_part", "_at", "_ends")
    salts = max(1, -(-total // (shards * rows_per_group)))
    return ranked(dealt, ["shard"], [keyed(2), *map(F.col, keys)], salts, "slot")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``rows``.

    Size is the UTF-8 length of the text (NULL: none) plus 16.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffled_into_shards(stored(sized, "sized"), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
