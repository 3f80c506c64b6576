"""Aggregates that need more than one ``groupBy``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.operators.chunked import running
from lumberline.operators.windows import first_n


def distribution(df: DataFrame, keys: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """count, mean, stddev (sample), exact median and mean absolute deviation per key.

    Rows are folded to (key, value, count) before anything is ordered; the ordered
    pass is cut into chunks of values, so no task holds all values of a large key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(
        counts, keys, value,
        sums={"__upto": F.col("__n")},
        totals={"__total": F.col("__n"), "__sum": F.col("__n") * F.col(value)},
        width=width,
    )
    mean = F.col("__sum") / F.col("__total")
    low = F.floor((F.col("__total") + 1) / 2)
    high = F.floor((F.col("__total") + 2) / 2)
    start = F.col("__upto") - F.col("__n")

    def holds(position: Column) -> Column:
        return (start < position) & (position <= F.col("__upto"))

    spread = F.sum(F.col("__n") * (F.col(value) - mean) * (F.col(value) - mean))
    n = F.max("__total")
    return ranked.groupBy(*keys).agg(
        n.alias("n"),
        F.max(mean).alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("stddev"),
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"),
        (F.sum(F.col("__n") * F.abs(F.col(value) - mean)) / n).alias("avedev"),
    )


def nth_per_key(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column], n: int) -> DataFrame:
    """The ``n``-th event of each key; map tasks keep only the first ``n``."""
    return first_n(df, keys, ordering, n, rank="__nth").filter(F.col("__nth") == n).drop("__nth")
