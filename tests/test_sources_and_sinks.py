import gzip
import json

import pytest
from pyspark.sql import functions as F

from lumberline.plans.parse import parse
from lumberline.plans.patterns import PatternSet
from lumberline.sinks.snapshots import SnapshotStore
from lumberline.sinks.writers import QuerySet, as_json, as_text, text_output
from lumberline.sources.lines import merge_by_event_time, scan_lines, scan_sniffed, unpacked_lines
from lumberline.sources.tables import ReferenceTable, scan_csv, static_list
from lumberline.sources.tail import TailReader

TEN = ["2020-04-14T14:11:21+03:00\tlocalhost\t1234\tdata"] * 10


def test_plain_and_gzip_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(TEN) + "\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress("\n".join(TEN).encode()))
    (tmp_path / "hidden.log").write_bytes(gzip.compress(b"one\n") + gzip.compress(b"two\r\n\nthree"))
    assert scan_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log.gz")]).count() == 20
    got = scan_sniffed(spark, str(tmp_path / "hidden.log")).collect()
    assert [r.data for r in got] == ["one", "two", "", "three"]
    placed = scan_lines(spark, str(tmp_path / "a.log"), position=True).orderBy("file", "block", "line_id")
    assert placed.count() == 10


def test_unpacked_lines_in_small_steps():
    text = "\n".join(f"line {i} ä" for i in range(500))
    for content in (text.encode(), gzip.compress(text.encode())):
        assert [x for part in unpacked_lines(content, step=7, rows=9) for x in part] == text.split("\n")


def test_merge_by_event_time(lines):
    def at(second):
        return f"2020-04-14T14:11:{second:02d}+03:00\th\t1\t{second}"

    a, b = parse(lines(at(3), at(1)), PatternSet()), parse(lines(at(2), "no time"), PatternSet())
    assert [r["data"] for r in merge_by_event_time({"a": a, "b": b}).collect()] == ["no time", "1", "2", "3"]


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('cmd,description,severity\nmimikatz,"this, too",5\nscan,,3\n')
    got = scan_csv(spark, str(path), fields={"severity": "int"})
    assert [tuple(r) for r in got.collect()] == [("mimikatz", "this, too", 5), ("scan", "", 3)]
    inline = scan_csv(spark, content="value1,value2,value3\n", header=False, fields={"f1": "string", "f2": "string", "f3": "string"})
    assert [tuple(r) for r in inline.collect()] == [("value1", "value2", "value3")]
    with pytest.raises(ValueError):
        scan_csv(spark, content="a,b\n1\n")
    with pytest.raises(ValueError):
        scan_csv(spark, content="1,2", header=False)
    with pytest.raises(ValueError):
        scan_csv(spark)
    path.write_text('a,b\n"two\nlines",2\n')
    assert [tuple(r) for r in scan_csv(spark, str(path), multiline=True).collect()] == [("two\nlines", "2")]
    path.write_text("a,b\n1\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        scan_csv(spark, str(path)).collect()


def test_static_list(spark):
    got = static_list(spark, ["first", "second"])
    assert got.columns == ["data"] and [r.data for r in got.collect()] == ["first", "second"]


def test_reference_is_replaced_not_appended(spark, tmp_path):
    ref = ReferenceTable(spark, "commands", str(tmp_path), {"cmd": "string", "severity": "int", "note": "string"})
    first = spark.createDataFrame([("a", "5", "x")], "cmd string, severity string, ignored string")
    assert [tuple(r) for r in ref.load(first).collect()] == [("a", 5, None)]
    ref.load(spark.createDataFrame([("b", 1)], "cmd string, severity int"))
    assert [tuple(r) for r in ref.read().collect()] == [("b", 1, None)]
    assert [r.cmd for r in spark.sql("SELECT cmd FROM commands").collect()] == ["b"]


def test_formats(spark):
    df = spark.createDataFrame([(1, None, {"k": "v"})], "id int, gone string, m map<string,string>")
    df = df.withColumn("sub", F.struct(F.lit("bar").alias("foo")))
    (line,) = [json.loads(r.value) for r in as_json(df).collect()]
    assert line == {"id": 1, "gone": None, "m": {"k": "v"}, "sub": {"foo": "bar"}}
    (text,) = as_text(df, "${id}|${gone}|${m.k}|${m.x}|${sub.foo}|${sub}|$id|${}").collect()
    assert text.value == "1|${gone}|v|${m.x}|bar|${sub}|$id|${}"


def test_routing(spark, lines, tmp_path):
    rules = QuerySet()
    assert rules.add("q", lambda e: e.filter("data = 'x'")) == "q"
    assert rules.add("q", lambda e: e) == "q-1"
    rules.add("__hidden", lambda e: e)
    rules.add("quiet", lambda e: e, silent=True)
    outputs = {"bound": text_output(str(tmp_path / "output=bound"), "${data}", ["q"]), "all": text_output(str(tmp_path / "output=all"))}
    assert rules.routes(outputs) == {"bound": ["q"], "all": ["q", "q-1"]}
    rules.emit(lines("x", "y"), outputs)
    got = spark.read.text(str(tmp_path)).groupBy("output", "query").count().collect()
    assert {(r.output, r["query"]): r["count"] for r in got} == {("bound", "q"): 1, ("all", "q"): 1, ("all", "q-1"): 2}


def test_snapshots_keep_nulls_and_the_newest_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    df = spark.createDataFrame([("h", None, 1586862681000)], "host string, port int, logts_timestamp long")
    store.save("w", df.limit(0), 1)
    store.save("w", df, 2)
    store.save("w", df, 2)
    assert [tuple(r) for r in store.restore("w", df.schema).collect()] == [("h", None, 1586862681000)]
    again = df.withColumn("host", F.lit("after a restart"))
    SnapshotStore(spark, str(tmp_path)).save("w", again, 0)
    assert [r.host for r in store.restore("w", df.schema).collect()] == ["after a restart"]
    with pytest.raises(FileNotFoundError):
        store.restore("unknown", df.schema)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("a\nb\n")
    rules = QuerySet()
    rules.add("q", lambda e: e)
    handle = rules.foreach_batch({"o": text_output(str(tmp_path / "out"))})

    def twice(batch, number):
        handle(batch, number)
        handle(batch, number)

    for run in ("first", "second"):
        lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "data")
        stream = lines.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / run)).trigger(availableNow=True).start()
        stream.awaitTermination()
    # Two streams, each batch once.
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_gzip_that_ends_early_is_an_error_and_padding_is_not():
    content = gzip.compress(b"one\ntwo\n" * 1000)
    for step in (7, 1 << 20):
        with pytest.raises(EOFError):
            list(unpacked_lines(content[: len(content) // 2], step=step))
        padded = content + bytes(512) + content + bytes(3)
        assert sum(map(len, unpacked_lines(padded, step=step))) == 4000


def test_small_literal_is_broadcast(spark):
    big = spark.range(1000).select(F.col("id").cast("string").alias("data"), "id")
    joined = big.join(static_list(spark, ["1", "5"], "word"), F.col("data") == F.col("word"), "left_semi")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2


def test_a_second_reference_table_leaves_the_first_readable(spark, tmp_path):
    one, two = (ReferenceTable(spark, "pair", str(tmp_path), {"x": "int"}) for _ in range(2))
    first = one.load(spark.createDataFrame([(1,)], "x int"))
    two.load(spark.createDataFrame([(2,)], "x int"))
    assert first.first().x == 1 and one.read().first().x == 2


def test_tail_reader_offsets(tmp_path, monkeypatch):
    import lumberline.sources.tail as tail_module

    f = tmp_path / "a.log"
    f.write_bytes(b"one\ntwo\npart")
    (tmp_path / "z.log").write_bytes(gzip.compress(b"skip\n"))
    end_reader = TailReader({"path": str(tmp_path / "*.log")})
    assert {name: seen["at"] for name, seen in end_reader.initialOffset().items()} == {str(f): 8}
    reader = TailReader({"path": str(tmp_path / "*.log"), "from": "start"})
    monkeypatch.setattr(tail_module, "_SPLIT_BYTES", 3)

    def read(start, end):
        return [row[2] for p in reader.partitions(start, end) for row in reader.read(p)]

    first = reader.latestOffset()
    assert read({}, first) == ["one", "two"]
    with f.open("ab") as out:
        out.write(b"ial\n\nlast\n")
    second = reader.latestOffset()
    assert read(first, second) == ["partial", "", "last"]
    f.write_bytes(b"new\n")
    assert read(second, reader.latestOffset()) == ["new"]


def test_queries_in_one_pass_equal_queries_one_by_one(spark):
    from lumberline.sinks.writers import QuerySet, tagged, tagged_rows

    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y"), (4, "ab", "z")], "i int, k string, v string")
    has_a, has_b = F.col("k").contains("a"), F.col("k").contains("b")
    rules = QuerySet()
    rules.add("first", lambda e: e.filter(has_a).select("i", "v"))
    rules.add("second", lambda e: e.filter(has_b).select("k", "i"))
    want = sorted((r.query, r.value) for r in tagged(rules.results(df)).collect())
    got = tagged_rows(df, {"first": (has_a, ["i", "v"]), "second": (has_b, ["k", "i"])})
    assert sorted((r.query, r.value) for r in got.collect()) == want and len(want) == 4
    with pytest.raises(ValueError, match="no queries"):
        tagged_rows(df, {})
