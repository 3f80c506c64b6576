"""Streams must give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from lumberline.operators import joins, sequence, windows
from lumberline.plans.parse import parse
from lumberline.plans.patterns import PatternSet
from lumberline.session import fresh_path
from lumberline.streaming import patterns as st
from lumberline.streaming.runner import LateRows, drain, drain_batches, from_time, on_event_clock, on_wall_clock

SECOND = 1_000_000
FAR = 10_000_000  # closes every window at the end of a test
BASE = 7_000  # time 0 would count as late from the start


@pytest.fixture(scope="module")
def source(spark):
    """Events in four files, as a batch frame and as a stream (one file per batch)."""
    rows = [(i, f"k{i % 3}", (BASE + i * 7 + (i * i) % 5) * SECOND, "aabab"[(i // 3) % 5]) for i in range(120)]
    rows.append((999, "end", FAR * SECOND, "end"))
    path = fresh_path(spark, "stream-source")
    df = spark.createDataFrame(rows, "id int, key string, us long, kind string").withColumn("time", F.timestamp_micros("us"))
    for lo in range(0, 121, 31):
        df.filter((F.col("us") >= (BASE + lo * 7) * SECOND) & (F.col("us") < (BASE + (lo + 31) * 7) * SECOND)).coalesce(1).write.mode("append").parquet(path)
    df.filter("id = 999").coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return spark.read.schema(df.schema).parquet(path), stream


def split(df, a="a", b="b"):
    left = df.filter(F.col("kind") == a).select(F.col("id").alias("a"), F.col("key").alias("x"), F.col("us").alias("ta"), F.col("time").alias("a_time"))
    right = df.filter((F.col("kind") == b) | (F.col("kind") == "end")).select(F.col("id").alias("b"), F.col("key").alias("y"), F.col("us").alias("tb"), F.col("time").alias("b_time"))
    return left, right


def pairs(df):
    return sorted((r.a, r.b) for r in df.select("a", "b").collect())


def test_interval_join(spark, source):
    batch, stream = source
    a, b = split(batch)
    want = pairs(joins.interval_join(a, b, [("x", "y")], "ta", "tb", 60 * SECOND))
    a, b = split(stream())
    out = st_join = joins.interval_join_stream(a, b, [("x", "y")], "a_time", "b_time", "60 seconds", "30 seconds")
    assert st_join.isStreaming
    assert pairs(drain(spark, out.select("a", "b"), "join")) == want and want


def test_sequence_and_absence(spark, source):
    batch, stream = source
    # The closing event is on both sides, so that both clocks reach the end.
    def both(df):
        a, b = split(df)
        tail = df.filter("kind = 'end'").select(F.col("id").alias("a"), F.col("key").alias("x"), F.col("us").alias("ta"), F.col("time").alias("a_time"))
        return a.unionByName(tail), b

    a, b = both(batch)
    seq = sequence.followed_by(a, b, [("x", "y")], "ta", "tb", 20 * SECOND, ["b"])
    absent = sequence.not_followed_by(a, b, [("x", "y")], "ta", "tb", 20 * SECOND, F.lit(FAR * SECOND))
    want_seq, want_absent = pairs(seq), sorted(r.a for r in absent.collect())
    a, b = both(stream())
    out = st.followed_by_stream(a, b, [("x", "y")], "a_time", "b_time", "20 seconds", ["a"], "b", "30 seconds")
    assert pairs(drain(spark, out.select("a", "b"), "seq")) == want_seq and want_seq
    a, b = both(stream())
    out = st.not_followed_by_stream(a, b, [("x", "y")], "a_time", "b_time", "20 seconds", "30 seconds")
    got = sorted(r.a for r in drain(spark, out.select("a"), "absent").collect())
    assert [x for x in got if x != 999] == want_absent and want_absent


def test_windows_and_sessions(spark, source):
    batch, stream = source
    want = windows.time_batch(batch, ["key"], "time", "1 minute", [F.count("*").alias("n")]).filter("key <> 'end'")
    out = windows.time_batch(stream().withWatermark("time", "1 minute"), ["key"], "time", "1 minute", [F.count("*").alias("n")])
    got = drain(spark, out, "windows").filter("key <> 'end'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = windows.sessions(batch, ["key"], "us", 22 * SECOND, sums={"n": F.lit(1)}).filter("key <> 'end'")
    out = windows.sessions_stream(stream(), ["key"], "time", "22 seconds", [F.count("*").alias("n")], "1 minute")
    got = drain(spark, out, "sessions").filter("key <> 'end'")
    starts = F.unix_micros("session_start").alias("s")
    assert sorted(map(tuple, got.select("key", starts, "n").collect())) == sorted(
        map(tuple, want.select("key", "session_start", "n").collect())
    )


def test_duplicates(spark, source):
    batch, stream = source
    want = {r.key: r.id for r in windows.first_per_key(batch, ["key"], "us").collect()}
    got = drain(spark, st.first_within(stream(), ["key"], "time", "365 days"), "dedup").collect()
    assert len(got) == len(want) and {r.key for r in got} == set(want)


def test_last_value(spark, source):
    batch, stream = source
    a, b = split(batch)
    want = pairs(joins.last_value_join(a, b, [("x", "y")], "ta", "tb", ["b"]))
    a, b = split(stream())
    base = fresh_path(spark, "asof")
    join = st.LastValueJoin(f"{base}/kept", "x", "ta", ["b"], lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    drain_batches(spark, st.both_sides(a, b, "y", "tb", ["b"]), "asof", join)
    assert pairs(spark.read.parquet(f"{base}/out")) == want and want


def test_last_value_keeps_types_and_replays(spark):
    """Large integers stay exact, equal times have one winner, NULL keys find nothing, batches may be smaller than Arrow's."""
    big = 9007199254740993
    schema = "left struct<k:string,id:bigint,t:bigint>, right struct<key:string,us:bigint,values:struct<v:bigint,w:string>>"
    first = [(("k", big, 20), None), ((None, 1, 20), None), (None, ("k", 10, (big, "x"))), (None, ("k", 10, (big, None))), (None, (None, 5, (1, "n")))]
    second = [(("k", 3, 30), None), (("k", 4, 12), None), (None, ("k", 25, (big + 2, "y"))), (None, ("j", 1, (5, "j")))]
    third = [(("k", 5, 2), None), (("j", 6, 99), None)]
    base, out = fresh_path(spark, "asof-small"), {}
    join = st.LastValueJoin(base, "k", "t", ["v", "w"], lambda df, n: out.__setitem__(n, {(r.id, r.v, r.w) for r in df.collect()}))
    frames = [spark.createDataFrame(rows, schema) for rows in (first, second, third)]
    want = [{(big, big, "x"), (1, None, None)}, {(3, big + 2, "y"), (4, big, "x")}, {(5, big + 2, "y"), (6, 5, "j")}]
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for number in (0, 1, 1, 2, 2):
            join(frames[number], number)
            assert out[number] == want[number]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parse_is_the_same_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("2020-04-14T14:11:21+03:00\th\t1\tuser=3 x\nplain\n")
    ps = PatternSet([{"name": "app", "parent": "logevents", "pattern": "user=%{INT:u} %{LD:rest}"}])
    read = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "data")
    stream = parse(read, ps)
    batch = parse(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "data"), ps)
    assert sorted(map(str, drain(spark, stream, "parse").collect())) == sorted(map(str, batch.collect()))
    assert on_event_clock(stream).isStreaming and "event_time" in on_wall_clock(batch).columns
    assert from_time(batch, 1586862681000).count() == 1 and from_time(batch, 1586862681001).count() == 0


def test_late_rows_are_set_apart_not_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    for times in ([100, 200], [150, 190, 250], [90, 260]):
        spark.createDataFrame([(t,) for t in times], "logts_timestamp long").coalesce(1).write.mode("append").parquet(path)
    on_time, late = [], []
    handler = LateRows(
        20,
        lambda df, n: on_time.extend(r[0] for r in df.collect()),
        lambda df, n: late.extend(r[0] for r in df.collect()),
        str(tmp_path / "clock"),
    )
    stream = spark.readStream.schema("logts_timestamp long").option("maxFilesPerTrigger", 1).parquet(path)
    drain_batches(spark, stream, "late", handler)
    assert sorted(on_time) == [100, 190, 200, 250, 260] and sorted(late) == [90, 150]
    # A new handler over the same folder goes on with the clock, and replays alike.
    after = []
    again = LateRows(20, lambda df, n: None, lambda df, n: after.extend(r[0] for r in df.collect()), str(tmp_path / "clock"))
    for _ in range(2):
        again(spark.createDataFrame([(239,), (240,)], "logts_timestamp long"), 3)
    assert after == [239, 239]
