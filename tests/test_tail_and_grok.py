"""Files that are truncated, replaced and regrown; the published grok names."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from lumberline.functions.grok import compile_grok
from lumberline.plans.parse import parse
from lumberline.plans.patterns import PatternSet
from lumberline.session import fresh_path
from lumberline.sources.tail import TailReader, tail


def lines_between(reader, start, end):
    return [line for part in reader.partitions(start, end) for _, _, line in reader.read(part)]


@pytest.fixture
def reader(tmp_path):
    return TailReader({"path": str(tmp_path / "*.log"), "from": "start"})


def test_a_file_that_grows_is_read_once(tmp_path, reader):
    name = tmp_path / "a.log"
    name.write_text("one\ntwo\nhalf")
    first = reader.latestOffset()
    assert lines_between(reader, {}, first) == ["one", "two"]
    with open(name, "a") as f:
        f.write(" a line\nthree\n")
    second = reader.latestOffset()
    assert lines_between(reader, first, second) == ["half a line", "three"]
    assert lines_between(reader, second, reader.latestOffset()) == []


@pytest.mark.parametrize("head", ["", "the same header line\n" * 100])
def test_truncated_and_regrown_past_its_old_position(tmp_path, reader, head):
    name = tmp_path / "a.log"
    name.write_text(head + "one\ntwo\n")
    first = reader.latestOffset()
    with open(name, "r+") as f:  # the same inode
        f.truncate(0)
        f.write(head + "new\n" * 50)
    second = reader.latestOffset()
    assert second[str(name)]["at"] > first[str(name)]["at"]
    assert lines_between(reader, first, second) == (head + "new\n" * 50).split("\n")[:-1]


def test_truncated_to_less_and_replaced_by_another_file(tmp_path, reader):
    name = tmp_path / "a.log"
    name.write_text("one\ntwo\nthree\n")
    first = reader.latestOffset()
    name.write_text("x\n")
    second = reader.latestOffset()
    assert lines_between(reader, first, second) == ["x"]
    other = tmp_path / "new"
    other.write_text("from another file\nand more\n")
    os.replace(other, name)
    third = reader.latestOffset()
    assert lines_between(reader, second, third) == ["from another file", "and more"]


def test_offsets_of_an_earlier_version_and_files_that_go(tmp_path, reader):
    name = tmp_path / "a.log"
    name.write_text("one\ntwo\n")
    assert lines_between(reader, {str(name): 4}, reader.latestOffset()) == ["two"]
    assert lines_between(reader, {str(name): 99}, reader.latestOffset()) == ["one", "two"]
    name.unlink()
    assert reader.latestOffset() == {}


def test_unchanged_files_are_not_opened_again(tmp_path, reader, monkeypatch):
    (tmp_path / "a.log").write_text("one\n")
    (tmp_path / "b.log").write_bytes(gzip.compress(b"packed\n"))
    first = reader.latestOffset()
    assert [os.path.basename(n) for n in first] == ["a.log"]

    def refused(*args, **kwargs):
        raise AssertionError("opened")

    monkeypatch.setattr("builtins.open", refused)
    assert reader.latestOffset() == first


def test_a_stream_loses_nothing_over_a_restart(spark, tmp_path):
    name, base = tmp_path / "a.log", fresh_path(spark, "tail-restart")

    def run():
        query = (
            tail(spark, str(name), from_end=False).writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(r.data for r in spark.read.parquet(f"{base}/out").collect())

    name.write_text("one\ntwo\n")
    assert run() == ["one", "two"]
    with open(name, "r+") as f:
        f.truncate(0)
        f.write("three\nfour\nfive\n")
    assert run() == ["five", "four", "one", "three", "two"]


SAMPLES = {
    "BASE16FLOAT": (["0x1F.8", "ab", "1.5"], ["xyz", "0x"]),
    "MAC": (["00:1a:2B:3c:4d:5e", "00-1a-2B-3c-4d-5e", "001a.2B3c.4d5e"], ["00:1a:2B:3c:4d", "00:1a-2B:3c-4d:5e"]),
    "URN": (["urn:isbn:0451450523", "urn:a:b%20c"], ["isbn:045"]),
    "EMAILADDRESS": (["first.last+tag@mail.example.org"], ["nobody", "@x.org"]),
    "TTY": (["/dev/pts/3", "/dev/tty1"], ["/dev/null"]),
    "DATE": (["12/31/2020", "31.12.2020", "1-2-99"], ["2020"]),
    "DATESTAMP": (["12/31/2020 10:11:12", "31.12.2020-10:11:12.5"], ["31.12.2020"]),
    "DATESTAMP_RFC822": (["Mon Jan 5 2020 10:11:12 UTC"], ["Mon Jan 5"]),
    "DATESTAMP_RFC2822": (["Mon, 5 Jan 2020 10:11:12 +02:00", "Tue, 06 Jan 2020 10:11:12 +0200"], ["Mon 5 Jan 2020"]),
    "DATESTAMP_OTHER": (["Mon Jan 5 10:11:12 PST 2020"], ["Mon Jan 5 2020"]),
    "DATESTAMP_EVENTLOG": (["20200131235959"], ["2020"]),
    "HTTPDERROR_DATE": (["Mon Jan 05 10:11:12 2020"], ["Mon Jan"]),
    "MONTHNUM2": (["01", "12"], ["1", "13"]),
    "SYSLOGFACILITY": (["<3.14>"], ["<3>"]),
    "ISO8601_SECOND": (["60", "59.9"], ["61"]),
}


def test_published_names_match_their_samples(spark):
    for name, (good, bad) in SAMPLES.items():
        regex = compile_grok(f"%{{{name}:found}}").regex
        df = spark.createDataFrame([(t,) for t in good + bad], "t string")
        got = {r.t: r.m for r in df.withColumn("m", F.col("t").rlike(f"\\A(?:{regex})\\z")).collect()}
        assert got == dict.fromkeys(good, True) | dict.fromkeys(bad, False), name


def test_system_log_lines(spark):
    patterns = PatternSet([{"name": "sys", "pattern": "%{SYSLOGBASE} %{LD:message}"}])
    lines = ["Mar  7 00:00:14 web-1 sshd[42]: opened a session", "Dec 31 23:59:59 <4.6> 10.0.0.1 kernel: [0.0] booted", "not one"]
    rows = {r.message: r for r in parse(spark.createDataFrame([(t,) for t in lines], "data string"), patterns).collect()}
    one, two = rows["opened a session"], rows["[0.0] booted"]
    assert (one.timestamp, one.logsource, one.program, one.pid, one.facility) == ("Mar  7 00:00:14", "web-1", "sshd", "42", None)
    assert (two.logsource, two.program, two.facility, two.priority) == ("10.0.0.1", "kernel", "4", "6")
    assert rows[None].event_type == "events"
