"""Numbering rows of a group that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], order: list[Column], salts: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group, in the order of (salt of ``order``, ``order``).

    Groups are numbered in ``salts`` parts, each after the counted rows of the parts before it.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    keys = [*group, "_salt"]
    earlier = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*keys).agg(F.count("*").alias("_n"))
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    local = salted.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return local.join(base, keys).withColumn(name, F.col("_base") + F.col("_local")).drop("_salt", "_base", "_local")
