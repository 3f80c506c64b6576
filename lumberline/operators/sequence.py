"""Patterns over ordered events: sequences, absence, contexts, multi-line entries."""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.operators.chunked import carry_last, over_rows, running, running_since
from lumberline.operators.joins import exists_in_range, nearest_in_range
from lumberline.operators.windows import latest_per_key


def assemble_lines(
    lines: DataFrame,
    keys: Sequence[str],
    position: str,
    text: str,
    start: Column,
    separator: str = "\n",
    width: int | None = None,
    tie: Sequence[str] = (),
    max_chars: int | None = None,
) -> DataFrame:
    """Join physical lines into entries; a new entry begins where ``start`` holds.

    Lines stand in the order of ``position`` (a number), then ``tie``.

    Entry numbers come from a chunked running count, so one long file is not one
    task. The text of a single entry is one value and has to fit a row; ``max_chars``
    bounds it (see :func:`split_entries`), and adds ``entry_part`` and ``continues``.
    """
    if max_chars is None:
        numbered = running(lines, keys, position, sums={"entry": F.when(start, 1).otherwise(0)}, tie=tie, width=width)
        return join_lines(numbered, [*keys, "entry"], position, text, separator, tie)
    pieces = split_entries(lines, keys, position, text, start, separator, width, tie, max_chars)
    parts = mark_continued(gather_parts(pieces, keys, position, text, separator, tie, max_chars), keys)
    return joined_parts(parts, keys, text, separator)


def join_lines(
    numbered: DataFrame, group: Sequence[str], position: str, text: str, separator: str, tie: Sequence[str] = ()
) -> DataFrame:
    """One row for each group of lines: ``first_position``, ``n_lines`` and the joined text."""
    ordered = F.array_sort(F.collect_list(F.struct(position, *tie, text)))
    return (
        numbered.groupBy(*group)
        .agg(ordered.alias("__lines"), F.min(position).alias("first_position"))
        .withColumn("n_lines", F.size("__lines"))
        .withColumn(text, F.array_join(F.transform("__lines", lambda x: x[text]), separator))
        .drop("__lines")
    )


def _own_chars(text: str, separator: str) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) + F.lit(len(separator))


def split_entries(
    lines: DataFrame, keys: Sequence[str], position: str, text: str, start: Column, separator: str = "\n",
    width: int | None = None, tie: Sequence[str] = (), max_chars: int = 1 << 20, before: str = "__before",
) -> DataFrame:
    """Number the lines' entries, and cut entries of more than ``max_chars`` characters into parts.

    Adds ``entry``, ``entry_part`` (how often ``max_chars`` fits into the entry's characters
    before the line) and ``before``, those characters, and ``__entries``, the number of the
    last entry. Lines that already have a ``before`` go on with an entry that began
    earlier. A part holds at most ``max_chars`` and one line more; no line is lost.
    """
    if clash := {"entry", "entry_part", "continues"} & set(lines.columns):
        raise ValueError(f"lines already have columns named {sorted(clash)}")
    begins = F.when(start, 1).otherwise(0)
    reset = F.when(start, F.lit(0).cast("bigint"))
    if before in lines.columns:
        reset = F.coalesce(before, reset)
    own = _own_chars(text, separator)
    at = running_since(lines, keys, position, own, reset, "__at", begins, "entry", "__entries", tie, width)
    parts = {before: F.col("__at").cast("bigint"), "entry_part": F.floor(F.col("__at") / F.lit(max_chars)).cast("bigint")}
    return at.withColumns(parts).drop("__at")


def gather_parts(
    pieces: DataFrame, keys: Sequence[str], position: str, text: str, separator: str = "\n",
    tie: Sequence[str] = (), max_chars: int = 1 << 20, before: str = "__before", more: Sequence[Column] = (),
) -> DataFrame:
    """One row for each part of an entry: its lines in order as ``__lines``, ``first_position`` and the aggregates ``more``.

    ``__next`` is the part that the entry's next line, if there is one, belongs to.
    """
    ordered = F.array_sort(F.collect_list(F.struct(position, *tie, text, before)))
    reached = F.max(F.col(before) + _own_chars(text, separator))
    parts = pieces.groupBy(*keys, "entry", "entry_part").agg(
        ordered.alias("__lines"), F.min(position).alias("first_position"), reached.alias("__reached"), *more
    )
    return parts.withColumn("__next", F.floor(F.col("__reached") / F.lit(max_chars)).cast("bigint")).drop("__reached")


def mark_continued(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``continues``: a later part of the entry follows. Only parts that are full, which are few, are looked up."""
    later = parts.filter("entry_part > 0").select(F.struct(*keys, "entry", "entry_part").alias("__of"))
    full = parts.filter("__next > entry_part").join(later, F.struct(*keys, "entry", "__next") == F.col("__of"), "left")
    looked_up = full.withColumn("continues", F.col("__of").isNotNull()).drop("__of")
    return parts.filter("__next <= entry_part").withColumn("continues", F.lit(False)).unionByName(looked_up).drop("__next")


def joined_parts(parts: DataFrame, keys: Sequence[str], text: str, separator: str) -> DataFrame:
    """The parts' texts, as :func:`join_lines` gives them."""
    joined = F.array_join(F.transform("__lines", lambda x: x[text]), separator).alias(text)
    return parts.select(*keys, "entry", "entry_part", "continues", "first_position", F.size("__lines").alias("n_lines"), joined)


def followed_by(
    first: DataFrame, second: DataFrame, on: Sequence[tuple[str, str]],
    first_ts: str, second_ts: str, within_us: int, columns: Sequence[str],
) -> DataFrame:
    """``a -> b within t``: each ``a`` with the earliest later ``b`` of its key."""
    found = nearest_in_range(first, second, on, first_ts, second_ts, within_us, columns, ahead=True)
    return found.filter(F.col(second_ts).isNotNull())


def not_followed_by(
    first: DataFrame, second: DataFrame, on: Sequence[tuple[str, str]],
    first_ts: str, second_ts: str, within_us: int, clock: Column,
) -> DataFrame:
    """``a`` without a ``b`` within t. Fires only once ``clock`` has passed the wait."""
    due = first.filter(F.col(first_ts) + F.lit(within_us) <= clock)
    return exists_in_range(due, second, on, first_ts, second_ts, within_us, ahead=True, negate=True)


def longest_match(pattern: str) -> int:
    """The most rows a pattern can span. Unbounded ones, and ones that look past their match, are errors."""
    if re.search(r"\$|\\[bBzZ]|\(\?<?[=!]", pattern):
        raise ValueError(f"row pattern {pattern!r} looks at rows outside its match")
    most = _parser.parse(pattern).getwidth()[1]
    if most >= 1 << 20:
        raise ValueError(f"row pattern {pattern!r} has no bound on its length: write x{{1,n}} for x+")
    return most


def match_rows(
    df: DataFrame, keys: Sequence[str], order: str, symbol: Column, pattern: str, longest: int,
    identity: str, tie: Sequence[str] = (),
) -> DataFrame:
    """Rows where a regular expression over one-letter row symbols starts to match.

    ``longest`` bounds the rows a match may span, which is what lets the search
    run on chunks; a pattern that can span more is an error, so that no match is
    lost or cut. Every start is reported (the next match may overlap).
    """
    if longest_match(pattern) > longest:
        raise ValueError(f"row pattern {pattern!r} spans up to {longest_match(pattern)} rows, more than {longest}")

    def look(w) -> dict[str, Column]:
        frame = w.rowsBetween(0, longest - 1)
        return {
            "__symbols": F.array_join(F.collect_list("__symbol").over(frame), ""),
            "__ids": F.collect_list(identity).over(frame),
        }

    seen = over_rows(df.withColumn("__symbol", symbol), keys, order, look, ahead=longest - 1, tie=tie)
    length = F.length(F.regexp_extract("__symbols", rf"\A({pattern})", 1))
    return (
        seen.withColumn("match_length", length)
        .filter(F.col("match_length") > 0)
        .withColumn("last_" + identity, F.element_at("__ids", F.col("match_length")))
        .drop("__symbols", "__ids", "__symbol", "seq")
    )


def contexts(
    df: DataFrame, keys: Sequence[str], order: str, start: Column, end: Column,
    tie: Sequence[str] = (), width: int | None = None,
) -> DataFrame:
    """Rows inside ``start .. end`` stretches of their key, numbered by ``context``.

    A start inside an open stretch is an ordinary row; the closing row belongs to
    its stretch.
    """
    marker = F.when(start, F.lit(1)).when(end, F.lit(0))
    marked = df.withColumn("__marker", marker)
    before = carry_last(marked, keys, order, F.col("__marker"), "__before", tie, width, include_current=False)
    opens = (F.col("__marker") == 1) & (F.coalesce("__before", F.lit(0)) == 0)
    inside = (F.coalesce("__before", F.lit(0)) == 1) | (F.coalesce("__marker", F.lit(0)) == 1)
    counted = running(
        before, keys, order, sums={"context": F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0)}, tie=tie, width=width
    )
    return counted.filter(inside).drop("__marker", "__before")


def clocked(df: DataFrame, arrival: str, event_us: str, keys: Sequence[str] = (), name: str = "clock_us", tie=(), width: int | None = None) -> DataFrame:
    """Event clock at each arrival: the latest event time seen so far, never going back.

    Late events stay in the result; they are evaluated at the clock they meet.
    """
    return running(df, keys, arrival, maxima={name: F.col(event_us)}, tie=tie, width=width)


def upsert(
    base: DataFrame, changes: DataFrame, key: str, order: str, values: Sequence[str],
    deleted: Column, tie: Sequence[str] = (),
) -> DataFrame:
    """Apply the latest change per key to a keyed table: insert, update or delete."""
    last = latest_per_key(changes.withColumn("__deleted", deleted), [key], order, tie)
    new = last.select(F.col(key).alias("__key"), "__deleted", *[F.col(v).alias("__new_" + v) for v in values])
    joined = base.join(new, base[key] == new["__key"], "full_outer")
    kept = joined.filter(F.coalesce(~F.col("__deleted"), F.lit(True)))
    changed = F.col("__key").isNotNull()
    return kept.select(
        F.coalesce(key, "__key").alias(key),
        *[F.when(changed, F.col("__new_" + v)).otherwise(F.col(v)).alias(v) for v in values],
    )


def split_stream(df: DataFrame, routes: dict[str, Column], name: str = "target", otherwise: str | None = None) -> DataFrame:
    """Label each event with the first route whose condition holds."""
    label: Column | None = None
    for target, condition in routes.items():
        label = F.when(condition, target) if label is None else label.when(condition, target)
    if label is None:
        raise ValueError("no routes given")
    return df.withColumn(name, label.otherwise(F.lit(otherwise)))
