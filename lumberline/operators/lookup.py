"""Lookup tables: enrichment, black and white lists, networks.

No side carries a broadcast hint. Catalyst broadcasts a lookup table when its
size, known or measured by adaptive execution, is below
``spark.sql.autoBroadcastJoinThreshold``; a larger one is joined by shuffle, where
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.binding import last_at_most
from lumberline.functions.net import address_key, masked_key, network_keys
from lumberline.session import fresh_path

Keys = Sequence[tuple[str, str]]


def _condition(on: Keys):
    cond = None
    for a, b in on:
        one = F.col(a) == F.col("__ref_" + b)
        cond = one if cond is None else cond & one
    return cond


def lookup_join(events: DataFrame, table: DataFrame, on: Keys, how: str = "left") -> DataFrame:
    """Enrich events with the columns of a reference table (inner or left)."""
    renamed = table.withColumnsRenamed({b: "__ref_" + b for _, b in on})
    joined = events.join(renamed, _condition(on), how)
    drop, keep = [], {}
    for a, b in on:
        if b in events.columns:
            drop.append("__ref_" + b)
        else:
            keep["__ref_" + b] = b
    return joined.drop(*drop).withColumnsRenamed(keep)


def only_listed(events: DataFrame, listed: DataFrame, on: Keys) -> DataFrame:
    """Events whose key is on the list (semi join)."""
    renamed = listed.select(*[F.col(b).alias("__ref_" + b) for _, b in on])
    return events.join(renamed, _condition(on), "left_semi")


def not_listed(events: DataFrame, listed: DataFrame, on: Keys) -> DataFrame:
    """Events whose key is not on the list (anti join)."""
    renamed = listed.select(*[F.col(b).alias("__ref_" + b) for _, b in on])
    return events.join(renamed, _condition(on), "left_anti")


BLOCK_POINTS = 1024
MOST_BLOCKS = 4096


def disjoint_ranges(networks: DataFrame, columns: Sequence[str], network: str = "network") -> tuple[DataFrame, int]:
    """``point, owner`` (and the most rows there can be): from each point up to the next one, addresses belong to ``owner``'s network (or to none).

    Networks (of both families, nested as they like) are swept into disjoint ranges. A
    range begins where a network does, and belongs to the longest that begins there; or
    behind a network's last address (the key of that address and ``~``, which sorts
    between it and the next), and belongs to the longest of those around it. These are
    found by equality of masked keys, one for each prefix length in the table. Networks
    that are equal are settled by the least values; those that cannot be read are left out.
    """
    keys = networks.select(network_keys(F.col(network)).alias("__net"), F.struct(*columns).alias("__info")).filter("__net is not null")
    nets = keys.groupBy("__net").agg(F.min("__info").alias("__info")).select("__net.lo", "__net.hi", "__net.len", "__info")
    begins = nets.groupBy("lo").agg(F.max_by("__info", "len").alias("owner")).select(F.col("lo").alias("point"), "owner")
    number, lengths = nets.agg(F.count(F.lit(1)), F.collect_set("len")).first()  # at most 129 lengths
    ends = nets.groupBy("hi").agg(F.min("len").alias("__least"))
    around = ends.withColumn("__len", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).filter("__len < __least")
    around = around.withColumn("__lo", masked_key(F.col("hi"), F.col("__len"), "0")).join(
        nets.select(F.col("lo").alias("__lo"), F.col("len").alias("__len"), "__info"), ["__lo", "__len"]
    )
    owners = around.groupBy(F.col("hi").alias("__hi")).agg(F.max_by("__info", "__len").alias("owner"))
    behind = ends.join(owners, F.col("hi") == F.col("__hi"), "left")
    return begins.unionByName(behind.select(F.concat("hi", F.lit("~")).alias("point"), "owner")), 2 * number


def range_blocks(ranges: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """``__block, __points, __owners``: the ranges in blocks of about equal size, in order; and each block's first point.

    ``most`` bounds the number of ranges. There are at most ``MOST_BLOCKS`` blocks, so that
    many texts come to the driver.
    """
    blocks = min(MOST_BLOCKS, -(-most // BLOCK_POINTS))
    if blocks > 1:
        path = fresh_path(ranges.sparkSession, "ranges")
        dealt = ranges.repartitionByRange(blocks, "point").withColumn("__block", F.spark_partition_id())
        dealt.write.parquet(path)
        ranges = ranges.sparkSession.read.schema(dealt.schema).parquet(path)
        firsts = ranges.groupBy("__block").agg(F.min("point").alias("first")).orderBy("first").collect()
        number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(firsts) for x in (r["__block"], i)]), F.col("__block"))
        ranges, points = ranges.withColumn("__block", number), [r["first"] for r in firsts]
    else:
        ranges, points = ranges.withColumn("__block", F.lit(0)), [""]
    listed = ranges.groupBy("__block").agg(F.array_sort(F.collect_list(F.struct("point", "owner"))).alias("__ranges"))
    return listed.select(
        "__block", F.transform("__ranges", lambda r: r["point"]).alias("__points"), F.transform("__ranges", lambda r: r["owner"]).alias("__owners")
    ), points


def cidr_join(
    events: DataFrame, ip: str, networks: DataFrame, columns: Sequence[str], network: str = "network"
) -> DataFrame:
    """Columns of the longest matching network for each address, IPv4 or IPv6 (NULLs on a miss).

    The networks become disjoint ranges, dealt into blocks by range. An address finds its
    block by binary search over the blocks' first points, meets it in one equality join,
    and finds its range in it by binary search. The event side is neither multiplied nor
    regrouped, and no block grows with how nested or bunched the networks are.
    """
    blocks, points = range_blocks(*disjoint_ranges(networks, columns, network))
    probed = events.withColumn("__ip", address_key(F.col(ip)))
    if len(points) > 1:
        block = last_at_most(F.array(*map(F.lit, points)), F.col("__ip"))
    else:
        block = F.lit(0)
    # Rows without an address match nothing; spread them instead of meeting in one task.
    nowhere = -2 - F.spark_partition_id()
    probed = probed.withColumn("__at", F.when(F.col("__ip").isNotNull(), block).otherwise(nowhere))
    joined = probed.join(blocks, F.col("__at") == F.col("__block"), "left")
    best = joined.withColumn("__best", F.get("__owners", last_at_most(F.col("__points"), F.col("__ip"))))
    return best.select(*events.columns, *[F.col(f"__best.{c}").alias(c) for c in columns])


cidr_join6 = cidr_join  # one operator for both families


def resolve_names(events: DataFrame, key: str, table: DataFrame, table_key: str, answer: str, name: str) -> DataFrame:
    """Name lookup from a table of known answers; a miss keeps the key itself."""
    answers = table.groupBy(table_key).agg(F.min(answer).alias("__answer"))
    joined = lookup_join(events, answers.withColumnRenamed(table_key, "__name_key"), [(key, "__name_key")])
    return joined.withColumn(name, F.coalesce("__answer", key)).drop("__answer", "__name_key")
