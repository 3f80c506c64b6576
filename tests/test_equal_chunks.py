"""Ordered work cut at quantiles: bunched keys, NULLs, ties, and the same results as plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumberline.operators import aggregates, chunked, joins, sequence, windows

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def bunched(spark):
    """A third of all rows in one minute of one key; the others over a month."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        if i % 3 == 0:
            rows.append((i, "hot", 10**9 + rng.randrange(MINUTE), i % 50, rng.choice("abc")))
        else:
            key = rng.choice(["hot", None, *[f"k{j}" for j in range(40)]])
            rows.append((i, key, None if i % 97 == 0 else rng.randrange(30 * 24 * 60 * MINUTE), i % 50, rng.choice("abc")))
    return spark.createDataFrame(rows, "id int, key string, t long, v int, kind string").cache()


@pytest.fixture(params=[300, 10**6])
def rows_per_chunk(request, monkeypatch):
    monkeypatch.setattr(chunked, "ROWS_PER_CHUNK", request.param)
    return request.param


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("keys", [["key"], []])
def test_no_chunk_over_twice_the_mean(bunched, monkeypatch, keys):
    monkeypatch.setattr(chunked, "ROWS_PER_CHUNK", 100)
    cut, single, key = chunked.chunks(bunched, keys, "t", None)
    rows = cut.filter("t is not null" + (" and key = 'hot'" if keys else "")).groupBy(*key, chunked.CHUNK).count()
    sizes = [r["count"] for r in rows.collect()]
    assert not single and len(sizes) > 15 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_small_keys_are_one_chunk(bunched):
    cut, single, _ = chunked.chunks(bunched, ["key"], "t", None)
    assert single and cut.select(chunked.CHUNK).distinct().count() == 1


@pytest.mark.parametrize("keys", [["key"], []])
def test_ordered_operators_equal_plain_windows(bunched, rows_per_chunk, keys):
    ordered = Window.partitionBy(*keys).orderBy("t", "id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("kind") == "a", F.col("v"))
    want = bunched.select(
        "id", F.row_number().over(ordered), F.sum("v").over(upto), F.max("v").over(upto), F.sum("v").over(Window.partitionBy(*keys)),
        F.last(mark, True).over(upto), F.last(mark, True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
        F.sum("v").over(ordered.rowsBetween(-2, 0)),
    )
    out = chunked.sequence_number(bunched, keys, "t", ["id"], name="n")
    out = chunked.running(out, keys, "t", {"total": F.col("v")}, {"high": F.col("v")}, totals={"all": F.col("v")}, tie=["id"])
    out = chunked.carry_last(out, keys, "t", mark, "at", ["id"])
    out = chunked.carry_last(out, keys, "t", mark, "before", ["id"], include_current=False)
    out = chunked.over_rows(out, keys, "t", lambda w: {"three": F.sum("v").over(w.rowsBetween(-2, 0))}, back=2, tie=["id"], rows_per_chunk=70)
    assert rows_of(out, "id", "n", "total", "high", "all", "at", "before", "three") == rows_of(want, *want.columns)


def test_previous_position_of_equal_times(bunched, rows_per_chunk):
    known = bunched.filter("t is not null").withColumn("t", F.floor(F.col("t") / 1_000_000))
    want = known.select("key", "t", F.lag("t").over(Window.partitionBy("key").orderBy("t")))
    got = chunked.previous_position(known, ["key"], "t", "before")
    assert rows_of(got, "key", "t", "before") == rows_of(want, *want.columns)


@pytest.mark.parametrize("gap", [1_000, 50_000, 30 * MINUTE])
def test_sessions_equal_plain_windows(bunched, rows_per_chunk, gap):
    known = bunched.filter("t is not null")
    w = Window.partitionBy("key").orderBy("t", "id")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap).cast("int"), F.lit(0))
    numbered = known.withColumn("f", fresh).withColumn("s", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = numbered.groupBy("key", "s").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.sum("v").alias("v"))
    got = windows.sessions(known, ["key"], "t", gap, {"n": F.lit(1), "total": F.col("v")})
    assert rows_of(got, "key", "session_start", "session_end", "n", "total") == rows_of(want, "key", "a", "b", "n", "v")


def test_a_million_sessions_of_one_key_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(chunked, "ROWS_PER_CHUNK", 50_000)
    df = spark.range(1_000_000).select(F.lit("one").alias("key"), (F.col("id") * 10).alias("t"))
    got = windows.sessions(df, ["key"], "t", 10, {"n": F.lit(1)})
    assert got.agg(F.count("*"), F.max("n"), F.min("session_start"), F.max("session_end")).first() == (1_000_000, 1, 0, 9_999_990)
    merged = windows.sessions(df, ["key"], "t", 11, {"n": F.lit(1)}).collect()
    assert [(r.session_start, r.session_end, r.n) for r in merged] == [(0, 9_999_990, 1_000_000)]
    cut, _, key = chunked.chunks(df, ["key"], "t", None)
    sizes = [r["count"] for r in cut.groupBy(*key, chunked.CHUNK).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100_000


def test_operators_built_on_chunks(bunched, rows_per_chunk):
    known = bunched.filter("t is not null and key is not null")
    fixed, equal = (sequence.contexts(known, ["key"], "t", F.col("kind") == "a", F.col("kind") == "c", ["id"], width=w) for w in (10**9, None))
    assert rows_of(fixed, "id", "context") == rows_of(equal, "id", "context")
    a = known.filter("kind = 'a'").select(F.col("id").alias("a"), F.col("key").alias("x"), F.col("t").alias("ta"))
    b = known.filter("kind = 'b'").select(F.col("id").alias("b"), F.col("key").alias("y"), F.col("t").alias("tb"))
    fixed, equal = (joins.last_value_join(a, b.dropDuplicates(["y", "tb"]), [("x", "y")], "ta", "tb", ["b"], width=w) for w in (10**9, None))
    assert rows_of(fixed, "a", "tb") == rows_of(equal, "a", "tb")
    values = known.withColumn("x", F.col("v") / 7)
    fixed, equal = (aggregates.distribution(values, ["key"], "x", width=w) for w in (1.0, None))
    for p, q in zip(rows_of(fixed, *fixed.columns), rows_of(equal, *equal.columns), strict=True):
        assert p[:2] == q[:2] and p[2:] == pytest.approx(q[2:])


def test_empty_tables(spark, rows_per_chunk):
    none = spark.createDataFrame([], "key string, t long, v int")
    assert chunked.running(none, ["key"], "t", {"s": F.col("v")}).collect() == []
    assert chunked.sequence_number(none, [], "t").collect() == []
    assert windows.sessions(none, ["key"], "t", 5, {"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("keys", [["key"], []])
def test_lines_are_numbered_and_measured_in_one_pass(bunched, rows_per_chunk, keys):
    """Entry, part and characters before each line, also where an entry spans chunks; lines are not joined with their entries."""
    lines = bunched.withColumn("text", F.repeat("kind", F.col("v"))).filter("t is not null")
    pieces = sequence.split_entries(lines, keys, "t", "text", F.expr("id % 40 = 0"), tie=["id"], max_chars=100)
    entry, part, before, rows = {}, {}, {}, lines.collect()
    for key in {r["key"] if keys else 0 for r in rows}:
        n = chars = 0
        for r in sorted((r for r in rows if not keys or r["key"] == key), key=lambda r: (r["t"], r["id"])):
            n, chars = (n + 1, 0) if r["id"] % 40 == 0 else (n, chars)
            entry[r["id"]], before[r["id"]], part[r["id"]] = n, chars, chars // 100
            chars += len(r["text"]) + 1
    found = pieces.select("id", "entry", "entry_part", "__before").collect()
    assert sorted(map(tuple, found)) == [(i, entry[i], part[i], before[i]) for i in sorted(entry)]
    if rows_per_chunk == 10**6:
        plan = pieces._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and plan.count("Window") <= 3


def test_the_chunk_search_is_compiled(bunched, monkeypatch):
    monkeypatch.setattr(chunked, "ROWS_PER_CHUNK", 100)
    cut, _, _ = chunked.chunks(bunched, [], "t", None)
    assert "aggregate(" not in cut._jdf.queryExecution().optimizedPlan().toString()
