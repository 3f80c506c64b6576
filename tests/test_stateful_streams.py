"""Streams with state of their own must give what the batch operators give over the rows the clock has passed."""

import itertools
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.operators import sequence, windows
from lumberline.session import fresh_path
from lumberline.sinks.snapshots import SnapshotStore
from lumberline.streaming import held
from lumberline.streaming import stateful as st
from lumberline.streaming.nfa import Matcher, compiled
from lumberline.streaming.runner import drain, drain_batches

SECOND = 1_000_000
BASE = 7_000
PARTS, EACH = 5, 40


@pytest.fixture(scope="module")
def source(spark):
    """200 events of odd order in five files (one per micro-batch), keys NULL among them, equal times and repeated rows."""
    rng = random.Random(2)
    rows = []
    for i in range(PARTS * EACH):
        at = BASE + (i // EACH) * 400 + rng.randrange(390)
        rows.append((i, rng.choice(["k0", "k1", None]), at * SECOND + rng.choice([0, 1, 999]), rng.choice("aab")))
    rows += rows[50:53]
    schema = "id int, key string, us long, kind string"
    df = spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_micros("us"))
    path = fresh_path(spark, "stateful-source")
    for i in range(PARTS):
        low = (BASE + i * 400) * SECOND
        df.filter((F.col("us") >= low) & (F.col("us") < low + 400 * SECOND)).coalesce(1).write.mode("append").parquet(path)
    clock = df.agg(F.max("us")).first()[0] // 1000
    passed = df.filter(F.floor(F.col("us") / 1000) < F.lit(clock)).cache()
    return passed, lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), clock * 1000


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("pattern", ["ab{1,2}a", "(a|ab)(b|ba)?", "a{1,3}?b", "[^a]a|a[a-b]{2}", "(a?b?){1,2}", "b(?:a|b{2}){0,2}a?"])
def test_automaton_prefers_what_a_search_prefers(pattern):
    for size in range(1, 8):
        for letters in itertools.product("abc", repeat=size):
            matcher, text = Matcher(compiled(pattern)), "".join(letters)
            for k, c in enumerate(letters):
                if not matcher.feed(c, k):
                    break
            found = re.match(pattern, text)
            assert matcher.best == (found.end() if found else 0), (pattern, text)
            assert matcher.best == 0 or matcher.best_mark == matcher.best - 1


@pytest.mark.parametrize("pattern", ["a+", "a(?=b)", "(a)\\1", "a\\d"])
def test_patterns_without_a_bound_or_a_meaning_are_errors(spark, source, pattern):
    with pytest.raises(ValueError, match="row pattern"):
        st.match_rows_stream(source[1](), ["key"], "time", F.col("kind"), pattern, 9, "id")


def test_row_pattern(spark, source):
    passed, stream, _ = source
    want = sequence.match_rows(passed, ["key"], "us", F.col("kind"), "ab{1,2}a", 4, "id", tie=["id"])
    got = drain(spark, st.match_rows_stream(stream(), ["key"], "time", F.col("kind"), "ab{1,2}a", 4, "id", ["id"]), "pattern")
    columns = ["key", "id", "last_id", "match_length"]
    assert rows_of(got, *columns) == rows_of(want, *columns) != []


def test_previous_event_rule(spark, source):
    passed, stream, _ = source
    want = windows.suppress_repeats(passed, ["key", "kind"], "us", 20 * SECOND, ["id"])
    got = drain(spark, st.suppress_repeats_stream(stream(), ["key", "kind"], "time", 20 * SECOND, ["id"], ["id"]), "dedup")
    assert rows_of(got, "key", "kind", "us", "id") == rows_of(want, "key", "kind", "us", "id") != []


def test_running_totals(spark, source):
    passed, stream, _ = source
    value, odd = (F.col("id") * 3 % 17), F.when(F.col("id") % 3 > 0, F.col("id") % 5 / 4)
    sums, maxima, minima = {"s": value.cast("bigint"), "o": odd}, {"hi": F.col("id")}, {"lo": odd}
    want = windows.running_totals(passed, ["key"], "us", {**sums, "n": F.lit(1)}, maxima, minima, ["id"])
    got = drain(spark, st.running_totals_stream(stream(), ["key"], "time", ["kind"], sums, maxima, minima, ["id"]), "running")
    columns = ["key", "us", "n", "kind", "s", "o", "hi", "lo"]
    assert got.columns == columns and rows_of(got, *columns) == rows_of(want, *columns) != []
    with pytest.raises(ValueError, match="named like"):
        st.running_totals_stream(stream(), ["key"], "time", ["kind"], {"kind": value})


def test_rows_that_leave_a_window_of_the_last(spark, source):
    passed, stream, _ = source
    w = Window.partitionBy("key").orderBy("us", "id")
    want = passed.withColumn("left_us", F.lead("us", 4).over(w)).filter("left_us is not null")
    got = drain(spark, st.length_window_stream(stream(), ["key"], "time", 4, ["id", "kind"], ["id"]), "length")
    assert rows_of(got, "key", "left_us", "us", "id", "kind") == rows_of(want, "key", "left_us", "us", "id", "kind") != []


def test_expiry(spark, source):
    passed, stream, clock = source
    got = drain(spark, st.expiries_stream(stream().select("id", "key", "time"), "time", "5 minutes", "0 seconds"), "expiry")
    want = passed.filter(F.col("us") + 300 * SECOND <= clock)
    assert rows_of(got, "id", "key", F.unix_micros("expires_at")) == rows_of(want, "id", "key", F.col("us") + 300 * SECOND) != []


@pytest.mark.parametrize("mode", ["first", "last", "snapshot"])
def test_output_rate(spark, source, mode):
    passed, stream, clock = source
    everything = drain(spark, stream(), "all-rows")
    want = windows.output_every(everything, ["key"], "us", 60 * SECOND, mode, ["id"]).filter(F.col("output_us") <= clock)
    got = drain(spark, st.output_every_stream(stream(), ["key"], "time", 60 * SECOND, mode, ["id", "kind"], ["id"]), "rate")
    assert rows_of(got, "key", "id", "kind", "output_us") == rows_of(want, "key", "id", "kind", "output_us") != []


def test_output_of_everything_and_of_nothing(spark, source):
    passed, stream, _ = source
    got = drain(spark, st.output_every_stream(stream(), ["key"], "time", 60 * SECOND, "all", ["id"]), "rate")
    want = windows.output_every(drain(spark, stream(), "all-rows"), ["key"], "us", 60 * SECOND, "all")
    assert rows_of(got, "key", "id", "output_us") == rows_of(want, "key", "id", "output_us")
    with pytest.raises(ValueError, match="mode"):
        st.output_every_stream(stream(), ["key"], "time", 60 * SECOND, "some", ["id"])


# -- named windows ----------------------------------------------------------------


def batches(spark, *parts, schema="k string, at long, v string"):
    return [spark.createDataFrame(p, schema) for p in parts]


@pytest.mark.parametrize(("merge", "want"), [
    (held.keep_all(), [("a", 1, "x"), ("a", 9, None), ("b", 2, "y"), ("b", 12, "z")]),
    (held.keep_latest(["k"], "at"), [("a", 9, None), ("b", 12, "z")]),
    (held.keep_time("at", 4), [("a", 9, None), ("b", 12, "z")]),
])
def test_a_window_is_saved_whole_and_restored(spark, merge, want):
    base, now = fresh_path(spark, "window"), [0.0]
    store = SnapshotStore(spark, f"{base}/store")
    schema = "k string, at long, v string"

    def window(folder):
        return held.NamedWindow(store, "w", f"{base}/{folder}", schema, merge, seconds=10, clock=lambda: now[0])

    one, two, three = batches(spark, [("a", 1, "x")], [("b", 2, "y")], [("a", 9, None), ("b", 12, "z")])
    first = window("a")
    assert first.contents().count() == 0
    first(one, 0)
    with pytest.raises(FileNotFoundError):
        store.restore("w", schema)  # not due yet
    now[0] = 11
    first(two, 1)
    first(two, 1)  # a replayed batch
    held_then = {tuple(r) for r in store.restore("w", schema).collect()}
    assert held_then <= {("a", 1, "x"), ("b", 2, "y")} and ("b", 2, "y") in held_then  # the window, not the batch
    second = window("b")  # a new checkpoint
    second(three, 0)
    second.save()
    second(three, 0)  # its first batch again, after a snapshot that holds its rows
    second.save()
    assert sorted(map(tuple, store.restore("w", schema).collect()), key=repr) == sorted(want, key=repr)
    assert rows_of(second.contents(), "k", "at", "v") == sorted(want, key=repr)


def test_a_stopped_stream_saves_its_window(spark, source):
    _, stream, _ = source
    base = fresh_path(spark, "window-stream")
    store = SnapshotStore(spark, f"{base}/store")
    window = held.NamedWindow(store, "w", f"{base}/held", "key string, id int, us long", held.keep_latest(["key"], "us", ["id"]))
    held.stop_window(held.run_window(stream(), window, f"{base}/checkpoint", availableNow=True), window, finish=True)
    want = windows.latest_per_key(drain(spark, stream(), "all-rows"), ["key"], "us", ["id"])
    assert rows_of(store.restore("w", "key string, id int, us long"), "key", "id", "us") == rows_of(want, "key", "id", "us")


# -- multi-line entries -------------------------------------------------------------


def log_lines(spark):
    rng, rows = random.Random(5), []
    for file in ("f", "g", None):
        for at in range(120):
            text = rng.choice(["> start", "  more", "  and " + "x" * rng.randrange(30), "", None])
            rows.append((file, at, text))
    rows += [("one", 0, "never a start")] + [("long", i, "> s" if i == 0 else "y" * 10) for i in range(200)]
    return spark.createDataFrame(rows, "file string, at long, text string")


@pytest.mark.parametrize(("max_chars", "cuts"), [(40, [30, 31, 90]), (1 << 20, [60]), (40, [])])
def test_entries_across_batches(spark, max_chars, cuts):
    lines, start = log_lines(spark), F.coalesce(F.col("text").startswith(">"), F.lit(False))
    columns = ["file", "first_position", "n_lines", "text", "entry_part", "continues"]
    want = sequence.assemble_lines(lines, ["file"], "at", "text", start, max_chars=max_chars, width=16)
    base, seen = fresh_path(spark, "lines"), {}
    handler = held.AssembleLines(
        f"{base}/open", ["file"], "at", "text", start, lambda df, n: seen.__setitem__(n, rows_of(df, *columns)), width=16, max_chars=max_chars
    )
    for number, (low, high) in enumerate(itertools.pairwise([0, *cuts, 1000])):
        part = lines.filter((F.col("at") >= low) & (F.col("at") < high))
        handler(part, number)
        handler(part, number)  # a replayed batch writes the same again
    handler.flush(spark)
    assert sorted(itertools.chain(*seen.values()), key=repr) == rows_of(want, *columns)
    # Every line came out, whatever the limit.
    assert sum(r[2] for rows in seen.values() for r in rows) == lines.count()
    if max_chars == 40:
        assert any(r[5] for rows in seen.values() for r in rows)
        assert max(len(r[3]) for rows in seen.values() for r in rows) <= 40 + 36


def test_an_idle_file_is_flushed(spark):
    base, now, seen = fresh_path(spark, "idle"), [0.0], {}
    handler = held.AssembleLines(
        f"{base}/open", ["file"], "at", "text", F.col("text").startswith(">"),
        lambda df, n: seen.__setitem__(n, rows_of(df, "file", "text")), flush_seconds=30, clock=lambda: now[0],
    )
    schema = "file string, at long, text string"
    handler(spark.createDataFrame([("f", 0, "> a"), ("f", 1, "b"), ("g", 0, "> c")], schema), 0)
    now[0] = 20
    handler(spark.createDataFrame([("g", 1, "d")], schema), 1)
    now[0] = 31
    handler(spark.createDataFrame([("h", 0, "> e")], schema), 2)
    assert seen == {0: [], 1: [], 2: [("f", "> a\nb")]}
    handler.flush(spark)
    assert seen[3] == [("g", "> c\nd"), ("h", "> e")]


def test_lines_with_clashing_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2)], "at long, text string, entry int")
    with pytest.raises(ValueError, match="entry"):
        sequence.assemble_lines(df, [], "at", "text", F.lit(True), max_chars=5)


def test_calls_on_the_state_do_not_grow_with_the_keys():
    """A thousand keys of one group cost as many calls on its state as one key."""

    class State(list):
        calls = 0

        def get(self):
            State.calls += 1
            return list(self) if self.many else self[0] if self else None

        def put(self, values):
            State.calls += 1
            self[:] = values

        update = lambda self, value: self.put([value])
        clear = lambda self: self.put([])

        def appendList(self, values):
            self.put([*self, *values])

        def __init__(self, many):
            self.many = many

    class Handle:
        getListState = lambda self, name, schema: State(True)
        getValueState = lambda self, name, schema: State(False)

        def registerTimer(self, ms):
            State.calls += 1

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    def run(n):
        State.calls = 0
        of = st._Suppress(T.StructType([T.StructField("id", T.LongType())]), ["id"], 10 * SECOND)
        of.names, of.n_keys = ["key", "us", "id"], 1
        of.init(Handle())
        rows = [(0, None, k, t * SECOND, t) for k in range(n) for t in (25, 1, 8)] + [(0, None, 0, None, 9)]
        out = [*of.handleInputRows(0, iter(rows), Clock(0)), *of.handleExpiredTimer(0, Clock(9_000), None)]
        assert sorted((r["key"], r["id"]) for r in out) == [(k, 1) for k in range(n)]
        out = list(of.handleExpiredTimer(0, Clock(26_000), None))
        assert sorted((r["key"], r["id"]) for r in out) == [(k, 25) for k in range(n)]
        assert not list(of.handleExpiredTimer(0, Clock(90_000), None)) and not of.kept and not of.waiting and not of.due
        return State.calls

    assert run(1000) == run(1) < 30


@pytest.mark.parametrize("keys", [["number"], ["key", "number"], []])
def test_keys_of_one_group_stay_apart(spark, source, keys, monkeypatch):
    """All keys in one group, NaN and both zeros among them, give each row the number that its own key counts."""
    passed, stream, _ = source
    monkeypatch.setattr(st, "GROUPS", 1)
    number = F.expr("CASE id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D END").alias("number")
    totals = st.running_totals_stream(stream().select("*", number), keys, "time", ["id"], tie=["id"])
    order = Window.partitionBy(*keys).orderBy("us", "id")
    expected = passed.select("*", number).withColumn("n", F.row_number().over(order))
    assert rows_of(drain(spark, totals, "grouped"), "id", "us", "n") == rows_of(expected, "id", "us", "n")
