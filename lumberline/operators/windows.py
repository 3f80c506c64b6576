"""Data windows: which recent events a result may look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.operators.chunked import (
    CHUNK,
    attach,
    chunks,
    over_range,
    over_rows,
    previous_position,
    running,
    sequence_number,
    slot_number,
)


def time_sliding(df: DataFrame, keys: Sequence[str], order: str, reach_us: int, aggregates: dict[str, Column]) -> DataFrame:
    """Each event with aggregates of the last ``reach_us``; an event leaves at exactly +reach."""
    return over_range(df, keys, order, reach_us, aggregates)


def length_sliding(
    df: DataFrame, keys: Sequence[str], order: str, n: int, aggregates: dict[str, Column], tie: Sequence[str] = ()
) -> DataFrame:
    """Each event with aggregates of the last ``n`` events (of its key, if any)."""

    def frame(w) -> dict[str, Column]:
        rows = w.rowsBetween(-(n - 1), 0)
        return {name: agg.over(rows) for name, agg in aggregates.items()}

    return over_rows(df, keys, order, frame, back=n - 1, tie=tie)


def time_batch(df: DataFrame, keys: Sequence[str], ts: str, every: str, aggregates: Sequence[Column]) -> DataFrame:
    """Tumbling windows; adds ``window_start`` and ``window_end``. Batch and stream."""
    grouped = df.groupBy(F.window(ts, every).alias("__w"), *keys).agg(*aggregates)
    return grouped.select(
        F.col("__w.start").alias("window_start"),
        F.col("__w.end").alias("window_end"),
        *[c for c in grouped.columns if c != "__w"],
    )


def length_batch(
    df: DataFrame, keys: Sequence[str], order: str, n: int, aggregates: Sequence[Column], tie: Sequence[str] = ()
) -> DataFrame:
    """Every complete run of ``n`` events; an unfinished last batch is not released."""
    numbered = sequence_number(df, keys, order, tie)
    batch = slot_number(F.col("seq") - 1, n)
    grouped = numbered.withColumn("batch", batch).groupBy(*keys, "batch").agg(*aggregates, F.count(F.lit(1)).alias("__n"))
    return grouped.filter(F.col("__n") == n).drop("__n")


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    gap_us: int,
    sums: dict[str, Column],
    width: int | None = None,
) -> DataFrame:
    """Runs of events less than ``gap_us`` apart, with start, end and summed values.

    Sessions are first built inside (key, chunk). Only the first local session of a
    chunk can go on with one of an earlier chunk, which follows from one summary row
    per chunk; the local sessions are then numbered and added up by partial aggregation.
    So no task holds all events, or all local sessions, of a large key.
    """
    cut, single, key = chunks(df, keys, order, width)
    part = [*key, CHUNK]
    w = Window.partitionBy(*part).orderBy(order)
    fresh = F.coalesce((F.col(order) - F.lag(order).over(w) >= F.lit(gap_us)).cast("int"), F.lit(0))
    numbered = cut.withColumn("__fresh", fresh).withColumn("__part", F.sum("__fresh").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    ends = [F.min(order).alias("session_start"), F.max(order).alias("session_end")]
    local = numbered.groupBy(*keys, *part, "__part").agg(*ends, *[F.sum(e).alias(n) for n, e in sums.items()])
    if single:
        return local.drop(*part, "__part")
    summary = numbered.groupBy(*part).agg(F.min(order).alias("__first"), F.max(order).alias("__last"), (F.max("__part") + 1).alias("__n"))
    earlier = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce((F.col("__first") - F.max("__last").over(earlier) < F.lit(gap_us)).cast("int"), F.lit(0))
    counted = summary.withColumn("__joined", goes_on)
    before = F.coalesce(F.sum(F.col("__n") - F.col("__joined")).over(earlier), F.lit(0)) - F.col("__joined")
    merged = attach(local, counted.select(*part, before.alias("__before")), part).withColumn("__session", F.col("__before") + F.col("__part"))
    totals = [F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end")]
    return merged.groupBy(*keys, "__session").agg(*totals, *[F.sum(n).alias(n) for n in sums]).drop("__session")


def sessions_stream(df: DataFrame, keys: Sequence[str], ts: str, gap: str, aggregates: Sequence[Column], lateness: str = "0 seconds") -> DataFrame:
    """Streaming form, on Spark's own session window."""
    grouped = df.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("__w"), *keys).agg(*aggregates)
    return grouped.select(
        F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"),
        *[c for c in grouped.columns if c != "__w"],
    )


def first_n(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key; map tasks already keep only ``n`` per key."""
    w = Window.partitionBy(*keys).orderBy(*ordering)
    name = rank or "__rank"
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    return first_n(df, keys, [F.col(c).desc() for c in (order, *tie)], 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    return first_n(df, keys, [F.col(c) for c in (order, *tie)], 1)


def sorted_window(df: DataFrame, n: int, ordering: Sequence[Column]) -> DataFrame:
    """The ``n`` extreme events of the whole stream (a top-k report)."""
    return df.orderBy(*ordering).limit(n)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, n: int, values: dict[str, Column], tie: Sequence[str] = ()
) -> DataFrame:
    """Adds values of the event ``n`` positions earlier."""
    return over_rows(df, keys, order, lambda w: {k: F.lag(v, n).over(w) for k, v in values.items()}, back=n, tie=tie)


def with_earlier(
    df: DataFrame, keys: Sequence[str], order: str, lags: dict[str, tuple[Column, int]], tie: Sequence[str] = ()
) -> DataFrame:
    """Adds for each name the value of the event so many positions earlier; rows are numbered once for all of them."""

    def columns(w) -> dict[str, Column]:
        return {name: F.lag(value, n).over(w) for name, (value, n) in lags.items()}

    return over_rows(df, keys, order, columns, back=max(n for _, n in lags.values()), tie=tie).drop("seq")


def expiries(df: DataFrame, order: str, reach_us: int, expires: str = "expires_us") -> DataFrame:
    """The events leaving a time window, stamped with when they leave.

    Only events the clock (the latest event time) has passed are emitted.
    """
    clock = df.agg(F.max(order)).scalar()
    return df.withColumn(expires, F.col(order) + F.lit(reach_us)).filter(F.col(expires) <= clock)


def suppress_repeats(df: DataFrame, keys: Sequence[str], order: str, within_us: int, tie: Sequence[str] = ()) -> DataFrame:
    """Drop an event that follows the previous one of its key by at most ``within_us``."""
    gap = F.col(order) - F.col("__prev")
    out = previous_position(df, keys, order, "__prev", tie)
    return out.filter(F.col("__prev").isNull() | (gap > F.lit(within_us))).drop("__prev")


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], maxima=None, minima=None, tie: Sequence[str] = ()) -> DataFrame:
    """The updated aggregate that each arriving event would emit."""
    return running(df, keys, order, sums, maxima, minima, tie=tie)


def rate(df: DataFrame, keys: Sequence[str], order: str, seconds: int, name: str = "rate") -> DataFrame:
    """Events per second over the last ``seconds``, at each event."""
    counted = over_range(df, keys, order, seconds * 1_000_000, {name: F.count(F.lit(1))})
    return counted.withColumn(name, F.col(name) / F.lit(float(seconds)))


def output_every(df: DataFrame, keys: Sequence[str], order: str, every_us: int, mode: str, tie: Sequence[str] = ()) -> DataFrame:
    """Rate-limited output: ``first``, ``last``, ``all`` or ``snapshot`` per interval.

    Adds ``output_us``, the end of the interval. ``snapshot`` repeats the latest
    row of every key at each later interval up to the last one of the stream.
    """
    slot = slot_number(F.col(order), every_us)
    slotted = df.withColumn("__slot", slot)
    end = ((F.col("__slot") + 1) * F.lit(every_us)).alias("output_us")
    cols = df.columns
    if mode == "all":
        return slotted.select(*cols, end)
    if mode == "first":
        return first_n(slotted, [*keys, "__slot"], [F.col(c) for c in (order, *tie)], 1).select(*cols, end)
    last = first_n(slotted, [*keys, "__slot"], [F.col(c).desc() for c in (order, *tie)], 1)
    if mode == "last":
        return last.select(*cols, end)
    if mode != "snapshot":
        raise ValueError(f"unknown output mode {mode!r}")
    final = slotted.agg(F.max("__slot").alias("m")).scalar()
    # One row per key and interval is left here, so a window per key stays small.
    until = F.coalesce(F.lead("__slot").over(Window.partitionBy(*keys).orderBy("__slot")) - 1, final)
    filled = last.withColumn("__until", until).withColumn("__slot", F.explode(F.sequence("__slot", "__until")))
    return filled.select(*cols, end)

