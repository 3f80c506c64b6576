"""Joins of event streams by key and time, without per-key nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.operators.chunked import HOUR_US, carry_last, slot_number

_SLOT = "__slot"


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    before_us: int,
    after_us: int = 0,
) -> DataFrame:
    """Pairs with equal keys and ``left_ts - before < right_ts < left_ts + after``.

    With ``after_us=0`` the upper end is ``right_ts <= left_ts``: the right side's
    last ``before_us`` seen from each left row. Column names of the two sides must
    differ. A time slot joins the equality keys, so a hot key is spread over all
    its slots and only rows of neighbouring slots are ever compared.
    """
    slot = max(before_us, after_us)
    lts, rts = F.col(left_ts), F.col(right_ts)
    low = slot_number(lts - F.lit(before_us) + 1, slot)
    high = slot_number(lts + F.lit(max(after_us - 1, 0)), slot)
    probes = left.withColumn(_SLOT, F.explode(F.sequence(low, high)))
    stored = right.withColumn("__slot_r", slot_number(rts, slot))
    cond = F.col(_SLOT) == F.col("__slot_r")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    cond = cond & (rts > lts - F.lit(before_us))
    cond = cond & ((rts < lts + F.lit(after_us)) if after_us else (rts <= lts))
    return probes.join(stored, cond).drop(_SLOT, "__slot_r")


def interval_join_stream(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    within: str,
    lateness: str = "0 seconds",
    how: str = "inner",
) -> DataFrame:
    """The same join on two streams; watermarks bound how long rows are kept."""
    a = left.withWatermark(left_time, lateness)
    b = right.withWatermark(right_time, lateness)
    cond = F.expr(f"{right_time} > {left_time} - INTERVAL {within} AND {right_time} <= {left_time}")
    for x, y in on:
        cond = cond & (F.col(x) == F.col(y))
    return a.join(b, cond, how)


def nearest_in_range(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    reach_us: int,
    right_columns: Sequence[str],
    ahead: bool = False,
    widest_slot_us: int = 6 * HOUR_US,
) -> DataFrame:
    """The nearest right row in reach of each left row, or NULLs.

    Looking back: latest with ``left_ts - reach < right_ts <= left_ts``. Ahead:
    earliest with ``left_ts < right_ts < left_ts + reach``. All left rows stay, none is multiplied, and
    no pairs are formed: one sort per (key, slot) carries the nearest right row
    along. This also answers existence and absence within a range. A reach wider
    than ``widest_slot_us`` goes through the as-of join, whose chunks do not grow
    with the reach.
    """
    if reach_us > widest_slot_us:
        return _nearest_far(left, right, on, left_ts, right_ts, reach_us, right_columns, ahead)
    payload = F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in right_columns])
    slot_of = slot_number(F.col("__t"), reach_us)
    names = list(left.columns)
    keyed_left = left.select(
        *[F.col(a).alias(f"__k{i}") for i, (a, _) in enumerate(on)],
        F.col(left_ts).alias("__t"),
        F.lit(1).alias("__side"),
        F.struct(*names).alias("__left"),
    ).withColumn(_SLOT, slot_of)
    step = -1 if ahead else 1
    keyed_right = (
        right.filter(F.col(right_ts).isNotNull())
        .select(
            *[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(on)],
            F.col(right_ts).alias("__t"),
            F.lit(0).alias("__side"),
            payload.alias("__right"),
        )
        .withColumn(_SLOT, F.explode(F.array(slot_of, slot_of + step)))
    )
    both = keyed_left.unionByName(keyed_right, allowMissingColumns=True)
    keys = [f"__k{i}" for i in range(len(on))]
    # On equal times the right row comes first when looking back; looking ahead
    # it is excluded, which the same (descending) order achieves with side 1 last.
    if ahead:
        order = [F.col("__t").desc(), F.col("__side").desc()]
    else:
        order = [F.col("__t"), F.col("__side")]
    w = Window.partitionBy(*keys, _SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("__right", ignorenulls=True).over(w)
    out = both.withColumn("__near", near).filter(F.col("__side") == 1)
    distance = (F.col("__near.__rts") - F.col("__t")) if ahead else (F.col("__t") - F.col("__near.__rts"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hit = F.when(known & (distance < F.lit(reach_us)), F.col("__near"))
    out = out.withColumn("__near", hit)
    return out.select(
        "__left.*",
        F.col("__near.__rts").alias(right_ts),
        *[F.col(f"__near.{c}").alias(c) for c in right_columns],
    )


def _nearest_far(left, right, on, left_ts, right_ts, reach_us, right_columns, ahead) -> DataFrame:
    # Looking ahead is looking back in negated time; one unit off keeps it strict.
    left_at = -F.col(left_ts) - 1 if ahead else F.col(left_ts)
    right_at = -F.col(right_ts) if ahead else F.col(right_ts)
    found = last_value_join(
        left.withColumn("__lt", left_at),
        right.withColumn("__rt", right_at),
        on, "__lt", "__rt", [right_ts, *right_columns],
    )
    distance = F.abs(F.col(right_ts) - F.col(left_ts))
    return found.withColumns(
        {c: F.when(distance < F.lit(reach_us), F.col(c)) for c in [*right_columns, right_ts]}
    ).drop("__lt", "__rt")


def found_in_range(left, right, on, left_ts, right_ts, reach_us, name: str, ahead=False) -> DataFrame:
    """All left rows, with ``name``: whether a right row is in reach. One pass answers existence and absence."""
    probe = "__found_ts"
    near = nearest_in_range(
        left, right.withColumnRenamed(right_ts, probe), on, left_ts, probe, reach_us, [], ahead
    )
    return near.withColumn(name, F.col(probe).isNotNull()).drop(probe)


def exists_in_range(left, right, on, left_ts, right_ts, reach_us, ahead=False, negate=False) -> DataFrame:
    """Left rows that have (or, negated, lack) a right row in reach."""
    found = found_in_range(left, right, on, left_ts, right_ts, reach_us, "__found", ahead)
    return found.filter(~F.col("__found") if negate else F.col("__found")).drop("__found")


def interval_outer_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    reach_us: int,
    how: str = "left",
) -> DataFrame:
    """Outer form of :func:`interval_join` (``left``, ``right`` or ``full``).

    Matched pairs come from the slotted join; rows without partner are found by
    an existence scan, so no side is ever joined without its time slot.
    """
    if how not in ("left", "right", "full"):
        raise ValueError(f"unknown outer join {how!r}")
    out = interval_join(left, right, on, left_ts, right_ts, reach_us)
    if how in ("left", "full"):
        alone = exists_in_range(left, right, on, left_ts, right_ts, reach_us, negate=True)
        out = out.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        flipped = [(b, a) for a, b in on]
        # right_ts <= left_ts < right_ts + reach: look ahead from one unit earlier.
        shifted = right.withColumn("__from", F.col(right_ts) - 1)
        lefts = left.select(*[a for a, _ in on], F.col(left_ts).alias("__left_t"))
        alone = exists_in_range(shifted, lefts, flipped, "__from", "__left_t", reach_us + 1, ahead=True, negate=True)
        out = out.unionByName(alone.drop("__from"), allowMissingColumns=True)
    return out


def last_value_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    right_columns: Sequence[str],
    width: int | None = None,
) -> DataFrame:
    """As-of join: the latest right row at or before each left row, however old."""
    keys = [f"__k{i}" for i in range(len(on))]
    names = list(left.columns)
    a = left.select(
        *[F.col(x).alias(k) for k, (x, _) in zip(keys, on)],
        F.col(left_ts).alias("__t"),
        F.lit(1).alias("__side"),
        F.struct(*names).alias("__left"),
    )
    b = right.select(
        *[F.col(y).alias(k) for k, (_, y) in zip(keys, on)],
        F.col(right_ts).alias("__t"),
        F.lit(0).alias("__side"),
        F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in right_columns]).alias("__right"),
    )
    both = a.unionByName(b, allowMissingColumns=True)
    carried = carry_last(both, keys, "__t", F.col("__right"), "__near", tie=["__side"], width=width)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    near = F.when(known, F.col("__near"))
    return (
        carried.filter(F.col("__side") == 1)
        .withColumn("__near", near)
        .select("__left.*", F.col("__near.__rts").alias(right_ts), *[F.col(f"__near.{c}").alias(c) for c in right_columns])
    )


def range_join(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    low: str,
    high: str,
    width: int,
    extra: Column | None = None,
) -> DataFrame:
    """Non-equi join ``low <= left_value < high`` (BIGINTs) through buckets of ``width``.

    Each range is stored under every bucket it touches; each left row looks into
    exactly one, so the join is an equality join and pairs appear once.
    """
    bucket = slot_number(F.col(left_value), width)
    first, last = slot_number(F.col(low), width), slot_number(F.col(high) - 1, width)
    stored = right.filter(F.col(low) < F.col(high)).withColumn("__bucket_r", F.explode(F.sequence(first, last)))
    probes = left.withColumn("__bucket", bucket)
    cond = (F.col("__bucket") == F.col("__bucket_r")) & (F.col(left_value) >= F.col(low)) & (F.col(left_value) < F.col(high))
    if extra is not None:
        cond = cond & extra
    return probes.join(stored, cond).drop("__bucket", "__bucket_r")
