"""Ordered work on streams, with state per key and event-time timers.

A row waits in its key's state until the watermark has passed it; then rows are taken
in event order, so the result does not depend on how the stream was cut into batches
and equals that of the batch operator over the rows the watermark has passed. Rows that
come after the watermark passed them are dropped by Spark, as on any watermarked stream.
State lives in RocksDB below the query's checkpoint. Every call on it from Python is a
round trip, so keys share state in ``GROUPS`` groups: a micro-batch makes a few calls for
each group with rows or a timer, however many keys there are. It reads and writes such
groups whole, and others not at all. Rows of one group are one task's work in a micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumberline.operators.sequence import longest_match
from lumberline.streaming.nfa import Matcher, compiled

GROUPS = 4096  # Fixed value: it is part of the state, so a checkpoint goes on with the number it began with.
ROWS_PER_VALUE = 5000
_ROW, _US = "__row", "__us"


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"__key_{i}" for i in range(len(keys))]


def _keyed(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str | Column], lateness: str) -> DataFrame:
    """The stream as (key columns, event time, its microseconds, row struct)."""
    watched = df.withWatermark(time, lateness)
    key = [F.col(k).alias(n) for k, n in zip(keys, _key_names(keys), strict=True)]
    return watched.select(*key, F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias(_US), F.struct(*columns).alias(_ROW))


def _field(df: DataFrame, name: str) -> T.StructType:
    return df.schema[name].dataType


class _Named(StatefulProcessor):
    """A processor whose output rows are tuples."""

    names: list[str]

    def named(self, rows: Iterable[tuple]) -> Iterator[Row]:
        make = Row(*self.names)
        for row in rows:
            yield make(*row)

    def close(self) -> None:
        pass


class InOrder(_Named):
    """Rows of a key in the order of (event time, ``tie``), once the watermark has passed them.

    ``take`` gets the key, what it kept for it (None at first), the rows that became ripe and
    the watermark (both times in microseconds); it yields output rows as tuples and returns
    what to keep (None: nothing). What it keeps is of simple types, as are the columns.

    It runs on groups of keys (see :func:`_run_in_order`). A group's waiting rows and what its
    keys keep are lists packed into a few values, so they cost a few calls, not one a row.
    """

    def __init__(self, row_type: T.StructType, tie: Sequence[str]):
        self.row_type, self.tie = row_type, list(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = T.StructType([T.StructField("rows", T.BinaryType())])
        self.waiting = handle.getListState("waiting", packed)  # (key's columns, microseconds, row's columns)
        self.kept = handle.getListState("kept", packed)  # (key, what it keeps)
        # When (in milliseconds) a row of the group gets ripe, or a key wants to be called.
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))

    def take(self, key: tuple, kept: Any, ripe: list[tuple[int, dict[str, Any]]], passed_us: int) -> Generator[tuple, None, Any]:
        raise NotImplementedError

    def wake(self, kept: Any) -> int | None:
        """When (in milliseconds) ``take`` wants to be called though no row may be waiting."""
        return None

    def _go_on(self, fresh: list[tuple], watermark_ms: int) -> Iterator[tuple]:
        us, names = self.n_keys, self.row_type.names
        known = self.due.get()
        due = known[0] if known else None
        soonest = min((x[us] // 1000 + 1 for x in fresh), default=None)
        if min((d for d in (due, soonest) if d is not None), default=watermark_ms + 1) > watermark_ms:
            if fresh:
                self.waiting.appendList(_packed(fresh))
                if due is None or soonest < due:
                    self._call_at(soonest)
            return
        waiting, kept = _unpacked(self.waiting), {_name(k): (k, v) for k, v in _unpacked(self.kept)}
        ripe, left = {}, []
        for x in waiting + fresh:
            if x[us] // 1000 < watermark_ms:
                ripe.setdefault(_name(x[:us]), []).append(x)
            else:
                left.append(x)
        ties = [us + 1 + names.index(t) for t in self.tie]
        for name in [*ripe, *[n for n, (_, v) in kept.items() if n not in ripe and self._due(v, watermark_ms)]]:
            rows = sorted(ripe.get(name, ()), key=lambda x: (x[us], *[_sortable(x[t]) for t in ties]))
            key, value = kept.pop(name, None) or (rows[0][:us], None)
            value = yield from self.take(key, value, [(x[us], dict(zip(names, x[us + 1 :], strict=True))) for x in rows], watermark_ms * 1000)
            if value is not None:
                kept[name] = key, value
        _put(self.waiting, left, bool(waiting))
        _put(self.kept, list(kept.values()), True)
        times = [x[us] // 1000 + 1 for x in left]
        times += [w for w in (self.wake(v) for _, v in kept.values()) if w is not None]
        if times:
            self._call_at(max(min(times), watermark_ms + 1))
        else:
            self.due.clear()

    def _due(self, value: Any, watermark_ms: int) -> bool:
        at = self.wake(value)
        return at is not None and at <= watermark_ms

    def _call_at(self, ms: int) -> None:
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Columns of the group, the event time, the key, its microseconds and the row.
        fresh = [x for x in (tuple(r)[2:] for r in rows) if x[self.n_keys] is not None]
        yield from self.named(self._go_on(fresh, max(timerValues.getCurrentWatermarkInMs(), 0)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.named(self._go_on([], max(timerValues.getCurrentWatermarkInMs(), 0)))


def _packed(rows: list) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[i : i + ROWS_PER_VALUE]),) for i in range(0, len(rows), ROWS_PER_VALUE)]


def _unpacked(state) -> list:
    return [row for value in state.get() for row in pickle.loads(value[0])]


def _put(state, rows: list, some: bool) -> None:
    """Replace a list; ``some``: it may hold something."""
    if rows:
        state.put(_packed(rows))
    elif some:
        state.clear()


def _name(key: tuple) -> tuple | str:
    """What keys have in common that Spark calls equal; NaN is equal to itself there, and lists can be keys."""
    return repr(tuple(k + 0.0 if isinstance(k, float) else k for k in key)) if any(isinstance(k, float | list | bytearray | tuple) for k in key) else key


def _sortable(value: Any) -> tuple:
    return value is not None, value if value is not None else 0


def _run(keyed: DataFrame, processor: StatefulProcessor, output: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Rows of ``processor`` (tuples of the key and ``output``), the key's columns in front."""
    names = _key_names(keys)
    processor.names = [*names, *output.names]
    shape = T.StructType([*[T.StructField(n, keyed.schema[n].dataType) for n in names], *output.fields])
    out = keyed.groupBy(*names).transformWithState(processor, shape, "append", "EventTime")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *output.names)


def _run_in_order(keyed: DataFrame, processor: InOrder, output: T.StructType, keys: Sequence[str]) -> DataFrame:
    """:func:`_run` for a processor that shares its state between the keys of a group."""
    names, time = _key_names(keys), keyed.columns[len(keys)]
    processor.names, processor.n_keys = [*names, *output.names], len(names)
    shape = T.StructType([*[T.StructField(n, keyed.schema[n].dataType) for n in names], *output.fields])
    group = F.pmod(F.xxhash64(*names) if names else F.lit(0), F.lit(GROUPS)).cast("int")
    row = [F.col(_ROW).getField(n).alias(f"__row_{i}") for i, n in enumerate(processor.row_type.names)]
    flat = keyed.select(group.alias("__group"), F.col(time), *names, _US, *row)
    out = flat.groupBy("__group").transformWithState(processor, shape, "append", "EventTime")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *output.names)


# -- row patterns ---------------------------------------------------------------


class _Match(InOrder):
    """Live matches of a key: their start, the pattern states they are in, and their best end so far."""

    def __init__(self, row_type, tie, program, identity: str):
        super().__init__(row_type, tie)
        self.program, self.identity = program, identity

    def take(self, key, kept, ripe, passed_us):
        if not ripe:
            return kept
        matchers = [(s, i, Matcher(self.program, list(states), n, b, b_id)) for s, i, states, n, b, b_id in kept or ()]
        for us, row in ripe:
            matchers.append((us, row[self.identity], Matcher(self.program)))
            still = []
            for start_us, start, m in matchers:
                if m.feed(row["symbol"], row[self.identity]):
                    still.append((start_us, start, m))
                elif m.best:
                    yield *key, start_us, start, m.best_mark, m.best
            matchers = still
        return [(s, i, list(m.states), m.length, m.best, m.best_mark) for s, i, m in matchers] or None


def match_rows_stream(
    df: DataFrame, keys: Sequence[str], time: str, symbol: Column, pattern: str, longest: int,
    identity: str, tie: Sequence[str] = (), lateness: str = "0 seconds",
) -> DataFrame:
    """:func:`lumberline.operators.sequence.match_rows` on a stream: an automaton over the rows of each key.

    Gives the key's columns, ``start_us``, ``identity``, ``last_<identity>`` and
    ``match_length``. Every row may start a match, and overlapping ones are all reported.
    A match goes out when no row to come can change it (a greedy repeat waits for the row
    that ends it). A key's state is the rows the watermark has not passed and at most
    ``longest`` live matches. A row whose symbol is NULL or not one letter ends every match.
    """
    if longest_match(pattern) > longest:
        raise ValueError(f"row pattern {pattern!r} spans up to {longest_match(pattern)} rows, more than {longest}")
    program = compiled(pattern)
    columns = [symbol.alias("symbol"), F.col(identity), *[F.col(t) for t in tie if t not in (identity, time)]]
    keyed = _keyed(df, keys, time, columns, lateness)
    row_type = _field(keyed, _ROW)
    id_type = row_type[identity].dataType
    output = T.StructType([
        T.StructField("start_us", T.LongType()), T.StructField(identity, id_type),
        T.StructField("last_" + identity, id_type), T.StructField("match_length", T.IntegerType()),
    ])
    return _run_in_order(keyed, _Match(row_type, [t for t in tie if t != time], program, identity), output, keys)


# -- duplicates -------------------------------------------------------------------


class _Suppress(InOrder):
    def __init__(self, row_type, tie, within_us: int):
        super().__init__(row_type, tie)
        self.within_us = within_us

    def take(self, key, kept, ripe, passed_us):
        last = kept
        for us, row in ripe:
            if last is None or us - last > self.within_us:
                yield *key, us, *row.values()
            last = us
        # Whatever comes once the watermark is past its reach is far enough from it.
        return None if last is None or last + self.within_us < passed_us else last

    def wake(self, kept):
        return (kept + self.within_us) // 1000 + 1


def suppress_repeats_stream(
    df: DataFrame, keys: Sequence[str], time: str, within_us: int, columns: Sequence[str],
    tie: Sequence[str] = (), lateness: str = "0 seconds",
) -> DataFrame:
    """:func:`lumberline.operators.windows.suppress_repeats` on a stream, by the previous event of the key.

    Gives the key's columns, ``us`` (event time in microseconds) and ``columns``. A key's
    state is the rows the watermark has not passed and one time, which is forgotten once
    the watermark is ``within_us`` past it.
    """
    keyed = _keyed(df, keys, time, [F.col(c) for c in dict.fromkeys([*columns, *tie])], lateness)
    row_type = _field(keyed, _ROW)
    output = T.StructType([T.StructField("us", T.LongType()), *row_type.fields])
    out = _run_in_order(keyed, _Suppress(row_type, tie, within_us), output, keys)
    return out.select(*keys, "us", *columns)


# -- running totals and the last rows ----------------------------------------------


class _Running(InOrder):
    """Sums, maxima and minima of a key so far, and its number of rows."""

    def __init__(self, row_type, tie, folds: dict[str, str], columns: Sequence[str]):
        super().__init__(row_type, tie)
        self.folds, self.columns = folds, list(columns)

    def take(self, key, kept, ripe, passed_us):
        n, *held = kept or (0, *[None] * len(self.folds))
        for us, row in ripe:
            n += 1
            for i, (name, fold) in enumerate(self.folds.items()):
                new = row[name]
                if held[i] is None or new is None:
                    held[i] = new if held[i] is None else held[i]
                else:
                    held[i] = held[i] + new if fold == "sum" else max(held[i], new) if fold == "max" else min(held[i], new)
            yield *key, us, n, *[row[c] for c in self.columns], *held
        return n, *held


def running_totals_stream(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None, minima: dict[str, Column] | None = None, tie: Sequence[str] = (), lateness: str = "0 seconds",
) -> DataFrame:
    """:func:`lumberline.operators.windows.running_totals` on a stream: the totals of its key at each event.

    Gives the key's columns, ``us``, ``n`` (the event's number in its key), ``columns`` and
    the named totals, which keep the types of their expressions (of ``bigint`` or ``double``,
    say); NULLs do not count. A key's state is the rows the watermark has not passed and one
    number for each total.
    """
    named = {n: (e, fold) for fold, group in (("sum", sums), ("max", maxima), ("min", minima)) for n, e in (group or {}).items()}
    if clash := set(named) & set(columns):
        raise ValueError(f"totals are named like columns: {sorted(clash)}")
    kept = [F.col(c) for c in dict.fromkeys([*columns, *tie])]
    keyed = _keyed(df, keys, time, [*kept, *[e.alias(n) for n, (e, _) in named.items()]], lateness)
    row_type = _field(keyed, _ROW)
    outs = [T.StructField(n, row_type[n].dataType) for n in [*columns, *named]]
    output = T.StructType([T.StructField("us", T.LongType()), T.StructField("n", T.LongType()), *outs])
    return _run_in_order(keyed, _Running(row_type, tie, {n: fold for n, (_, fold) in named.items()}, columns), output, keys)


class _LastRows(InOrder):
    """The last ``size`` rows of a key; what falls out of them is given with what pushed it out."""

    def __init__(self, row_type, tie, size: int, columns: Sequence[str]):
        super().__init__(row_type, tie)
        self.size, self.columns = size, list(columns)

    def take(self, key, kept, ripe, passed_us):
        window = kept or []
        for us, row in ripe:
            window.append((us, *[row[c] for c in self.columns]))
            if len(window) > self.size:
                gone = window.pop(0)
                yield *key, us, *gone
        return window


def length_window_stream(
    df: DataFrame, keys: Sequence[str], time: str, size: int, columns: Sequence[str], tie: Sequence[str] = (), lateness: str = "0 seconds",
) -> DataFrame:
    """The rows that leave a window of the last ``size`` events of their key.

    Gives the key's columns, ``left_us`` (the time of the event that pushed the row out),
    ``us`` (its own) and ``columns``. A key's state is the window and the rows the
    watermark has not passed.
    """
    if size < 1:
        raise ValueError("a window holds at least one event")
    keyed = _keyed(df, keys, time, [F.col(c) for c in dict.fromkeys([*columns, *tie])], lateness)
    row_type = _field(keyed, _ROW)
    output = T.StructType([T.StructField("left_us", T.LongType()), T.StructField("us", T.LongType()), *[row_type[c] for c in columns]])
    return _run_in_order(keyed, _LastRows(row_type, tie, size, columns), output, keys)


# -- expiry and output rate ---------------------------------------------------------


def expiries_stream(df: DataFrame, time: str, reach: str, lateness: str = "0 seconds", expires: str = "expires_at") -> DataFrame:
    """Each row once it has left a time window of ``reach``, stamped with when it left.

    The moment of leaving is the event time of a watermark that lags by ``reach`` (and
    ``lateness``) behind it, and rows are grouped by it, so Spark's own state keeps a row
    until then and lets it go. Rows are spread by all their columns; equal rows are
    counted and come out as often as they went in. Rows without an event time never leave.
    """
    columns = df.columns
    leaving = df.filter(F.col(time).isNotNull()).withColumn(expires, F.expr(f"CAST(`{time}` AS TIMESTAMP) + INTERVAL {reach}"))
    grouped = leaving.withWatermark(expires, f"{reach} {lateness}")
    counted = grouped.groupBy(expires, *columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).select(*columns, expires)


class _Snapshot(_Named):
    """The latest row of a key, repeated at the end of every interval the watermark has passed."""

    def __init__(self, row_type: T.StructType, every_us: int):
        self.row_type, self.every_us = row_type, every_us

    def init(self, handle) -> None:
        self.handle = handle
        # The last row of each interval that is not written yet; the newest written one stays.
        self.rows = handle.getMapState(
            "rows", T.StructType([T.StructField("end", T.LongType())]), self.row_type
        )
        self.next = handle.getValueState("next", T.StructType([T.StructField("end", T.LongType())]))

    def _write(self, key: tuple, watermark_ms: int) -> Iterator[tuple]:
        rows = {k[0]: tuple(v) for k, v in self.rows.iterator()}
        end = self.next.get()[0] if self.next.exists() else min(rows)
        held = max((k for k in rows if k < end), default=None)
        while end <= watermark_ms * 1000:
            if end in rows:
                if held is not None:
                    self.rows.removeKey((held,))
                held = end
            yield *key, end, *rows[held]
            end += self.every_us
        self.next.update((end,))
        self.handle.registerTimer(max(-(-end // 1000), watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.rows.updateValue((r[_US],), tuple(r[_ROW][n] for n in self.row_type.names))
        yield from self.named(self._write(key, max(timerValues.getCurrentWatermarkInMs(), 0)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.named(self._write(key, max(timerValues.getCurrentWatermarkInMs(), 0)))


def output_every_stream(
    df: DataFrame, keys: Sequence[str], time: str, every_us: int, mode: str, columns: Sequence[str],
    tie: Sequence[str] = (), lateness: str = "0 seconds",
) -> DataFrame:
    """:func:`lumberline.operators.windows.output_every` on a stream: ``first``, ``last``, ``all`` or ``snapshot``.

    Gives the key's columns, ``columns`` and ``output_us``, the end of the interval.
    ``all`` passes rows on as they come. The other modes write an interval once the
    watermark has passed its end. ``first`` and ``last`` are one partial aggregate per
    key and interval. ``snapshot`` goes on from the rows of ``last``: the latest row of
    each key is written at the end of every later interval too, by timers, as long as
    the watermark moves.
    """
    width = f"{every_us} microseconds"
    if mode == "all":
        us = F.unix_micros(F.col(time).cast("timestamp"))
        return df.select(*keys, *columns, (us - F.pmod(us, F.lit(every_us)) + every_us).alias("output_us"))
    if mode not in ("first", "last", "snapshot"):
        raise ValueError(f"unknown output mode {mode!r}")
    pick = F.min_by if mode == "first" else F.max_by
    picked = pick(F.struct(*columns), F.struct(time, *tie)).alias(_ROW)
    each = df.withWatermark(time, lateness).groupBy(F.window(time, width).alias("__w"), *keys).agg(picked)
    end = F.unix_micros("__w.end")
    if mode != "snapshot":
        return each.select(*keys, *[F.col(f"{_ROW}.{c}").alias(c) for c in columns], end.alias("output_us"))
    key = [F.col(k).alias(n) for k, n in zip(keys, _key_names(keys), strict=True)]
    keyed = each.select(*key, F.window_time("__w").alias("__at"), end.alias(_US), _ROW)
    row_type = _field(keyed, _ROW)
    output = T.StructType([T.StructField("output_us", T.LongType()), *row_type.fields])
    return _run(keyed, _Snapshot(row_type, every_us), output, keys).select(*keys, *columns, "output_us")
