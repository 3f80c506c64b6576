"""Sequence, absence, duplicates and as-of joins on unbounded streams.

Built on Spark's own stateful operators (stream-stream joins, watermarks), whose
state is partitioned by key and dropped once the watermark has passed. Only the
as-of join hands a row per key from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.operators.joins import last_value_join
from lumberline.streaming.runner import hand_on, handed_on


def _later(on: Sequence[tuple[str, str]], first_time: str, second_time: str, within: str):
    cond = F.expr(f"{second_time} > {first_time} AND {second_time} < {first_time} + INTERVAL {within}")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return cond


def followed_by_stream(
    first: DataFrame, second: DataFrame, on: Sequence[tuple[str, str]], first_time: str, second_time: str,
    within: str, keep: Sequence[str], answer: str, lateness: str = "0 seconds",
) -> DataFrame:
    """``a -> b within t``: each ``a`` (columns ``keep``) with ``answer`` of its earliest ``b``."""
    a = first.withWatermark(first_time, lateness)
    b = second.withWatermark(second_time, lateness)
    pairs = a.join(b, _later(on, first_time, second_time, within), "inner")
    # Grouping by the event time itself lets a row go out when the clock passes it.
    return pairs.groupBy(first_time, *keep).agg(F.min_by(answer, second_time).alias(answer))


def not_followed_by_stream(
    first: DataFrame, second: DataFrame, on: Sequence[tuple[str, str]], first_time: str, second_time: str,
    within: str, lateness: str = "0 seconds",
) -> DataFrame:
    """``a`` without a ``b`` within t, emitted once the watermark has passed the wait."""
    a = first.withWatermark(first_time, lateness)
    b = second.withWatermark(second_time, lateness)
    joined = a.join(b, _later(on, first_time, second_time, within), "left_outer")
    return joined.filter(F.col(second_time).isNull()).select(*first.columns)


def first_within(df: DataFrame, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """The first event per key; repeats are suppressed for at least ``within``."""
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def both_sides(left: DataFrame, right: DataFrame, key: str, right_us: str, right_columns: Sequence[str]) -> DataFrame:
    """Two streams as one, for :class:`LastValueJoin`: each row is a ``left`` or a ``right`` struct."""
    a = left.select(F.struct("*").alias("left"))
    b = right.select(F.struct(F.col(key).alias("key"), F.col(right_us).alias("us"), F.struct(*right_columns).alias("values")).alias("right"))
    return a.unionByName(b, allowMissingColumns=True)


class LastValueJoin:
    """``foreachBatch`` handler over :func:`both_sides`: an as-of join of two streams.

    A left row gets the latest right row of its key at or before it, in its own batch or
    kept from earlier ones (one row per key); right rows of one time and key are settled by
    their greatest values. Where a batch starts before the kept row, that row stands at the
    batch's first left row, so a late left row still finds one. Rows with a NULL key find
    nothing. The join is the batch operator, so values keep their types and a hot key is cut.

    The kept rows lie in two folders that take turns: a batch reads what its predecessor
    left, and a replayed batch writes its own folder again. ``write(result, number)`` has to
    replace what it wrote for the number before.
    """

    def __init__(self, folder: str, key: str, left_us: str, right_columns: Sequence[str], write: Callable[[DataFrame, int], None]):
        self.folder, self.key, self.left_us = folder, key, left_us
        self.right_columns, self.write = list(right_columns), write

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            lefts = batch.filter("left is not null").select("left.*")
            rights = batch.filter("right is not null").select("right.*").filter("key is not null")
            kept = handed_on(batch.sparkSession, self.folder, number, rights.schema)
            first = F.lit(lefts.agg(F.min(self.left_us)).first()[0]).cast("bigint")
            seen = rights.withColumn("__at", F.col("us")).unionByName(kept.withColumn("__at", F.least("us", first)))
            latest = F.max(F.struct("us", "values")).alias("__last")
            one = seen.groupBy("key", "__at").agg(latest)
            found = last_value_join(lefts, one, [(self.key, "key")], self.left_us, "__at", ["__last"])
            answers = [F.col(f"__last.values.{c}").alias(c) for c in self.right_columns]
            self.write(found.select(*lefts.columns, *answers), number)
            hand_on(seen.groupBy("key").agg(latest).select("key", "__last.us", "__last.values"), self.folder, number)
        finally:
            batch.unpersist()
