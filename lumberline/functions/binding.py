"""Naming an intermediate value, and searching a sorted array, inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_at_most(sorted_values: Column, value: Column) -> Column:
    """Place (from 0) of the last of some sorted values that is at most ``value``; -1 if none is. A binary search."""
    start = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))  # the answer + 1 is in low..high
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"] + 1, 1)
        fits = F.get(sorted_values, middle - 1) <= value
        halved = F.struct(
            F.when(fits, middle).otherwise(acc["low"]).alias("low"), F.when(fits, acc["high"]).otherwise(middle - 1).alias("high")
        )
        return F.when(acc["low"] < acc["high"], halved).otherwise(acc)

    return F.aggregate(steps, start, halve)["low"] - 1
