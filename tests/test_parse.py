"""Golden inputs, and a randomised comparison with a plain row-at-a-time model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumberline.functions.times import event_time_millis
from lumberline.plans.parse import events_of, parse, parse_inputs, parse_stats
from lumberline.plans.patterns import PatternSet, definition
from lumberline.sinks.writers import as_text

LINE = "2020-04-14T14:11:21+03:00\tlocalhost\t1234\tlogline"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_base_patterns(lines):
    assert len(PatternSet().nodes) == 2
    plain, log = rows(parse(lines("logline", LINE), PatternSet()))
    assert (plain["event_type"], plain["data"], plain["match_path"]) == ("events", "logline", ["events"])
    assert log["event_type"] == "logevents" and log["match_path"] == ["events", "logevents"]
    assert (log["host"], log["pid"], log["data"]) == ("localhost", "1234", "logline")
    assert log["logts_timestamp"] == 1586862681000


def test_siblings_and_children(lines):
    ps = PatternSet(
        [
            {"name": "amount", "parent": "events", "pattern": "%{INT:seen}"},
            {"name": "phrase", "parent": "events", "pattern": "%{LD:seen}"},
            {"name": "setting", "parent": "phrase", "field": "seen", "pattern": "key=%{LD:set_to}"},
        ]
    )
    df = parse(lines("key=keyval", "random string", "4"), ps)
    setting, phrase, amount = rows(df)
    assert setting["match_path"][-2:] == ["phrase", "setting"] and setting["set_to"] == "keyval"
    assert (phrase["event_type"], phrase["seen"], phrase["set_to"]) == ("phrase", "random string", None)
    assert (amount["event_type"], amount["seen"]) == ("amount", "4")
    assert [r["seen"] for r in rows(events_of(df, ps, "amount"))] == [4]
    assert set(ps.nodes) == {"events", "logevents", "amount", "phrase", "setting"}


def test_source_time(lines):
    ps = PatternSet(
        [
            {
                "name": "with_srctime", "parent": "events", "pattern": "%{TIMESTAMP_ISO8601:srctime}\t%{LD:data}",
                "srctime-field": "srctime", "srctime-format": "yyyy-MM-dd'T'hh:mm:ssX",
            }
        ]
    )
    (r,) = rows(parse(lines("2019-03-07T00:00:14+02:00\tmydata"), ps))
    assert r["src_logts_timestamp"] == 1551909614000 and r["data"] == "mydata"


def test_expression_replaces_root_and_infers_int(lines):
    ps = PatternSet(["%{LD:field_1}; %{LD:field_2}::%{INT:field_3}"])
    assert list(ps.nodes) == ["events"]
    (r,) = rows(parse(lines("custom; pattern::2345"), ps).filter("field_3 = 2345"))
    assert (r["field_1"], r["field_2"], r["field_3"]) == ("custom", "pattern", 2345)
    assert definition("typed@@%{INT:x}") == {"name": "typed", "pattern": "%{INT:x}"}


def test_template_golden(lines):
    parsed = parse(lines(LINE), PatternSet()).filter("host = 'localhost'")
    (r,) = rows(as_text(parsed, "Logline from ${host} @ ${logts}. Source PID was ${pid}. ${nope} ${dstip}"))
    assert r["value"] == "Logline from localhost @ 2020-04-14T14:11:21+03:00. Source PID was 1234. ${nope} ${dstip}"
    stats = {x["event_type"]: x for x in rows(parse_stats(lines(LINE, "x"), PatternSet()))}
    assert stats["logevents"]["matchcount"] == 1 and stats["logevents"]["nonmatches"] == 1


def test_event_time_spellings(spark):
    texts = [
        "2020-04-14T14:11:21+03:00", "2020-04-14T11:11:21Z", "2020-04-14T14:11:21+0300", "2020-04-14T14:11:21+03",
        "2020-04-14T11:11:21.250Z", "2020-04-14T11:11:21", "garbage",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(event_time_millis(F.col("t"))).collect()]
    assert got == [1586862681000] * 4 + [1586862681250, None, None]


def test_control_characters_take_the_exact_path(lines):
    (r,) = rows(parse(lines(LINE + "\x01tail\x01"), PatternSet()))
    assert r["event_type"] == "logevents" and r["data"] == "logline\x01tail\x01" and r["host"] == "localhost"
    (u,) = rows(parse(lines("no\x01match"), PatternSet([{"name": "n", "pattern": "%{INT:x}"}])))
    assert u["event_type"] == "events" and u["data"] == "no\x01match"


def test_bad_url_escape_and_bad_json_leave_the_level_open(lines):
    ps = PatternSet(
        [
            {"name": "args", "pattern": "GET %{URLARGS:q}", "fields": {"a": "string"}},
            {"name": "json", "pattern": "%{JSON:j}", "fields": {"a": "string"}},
            {"name": "rest", "order": 9, "pattern": "%{LD:rest}"},
        ]
    )
    got = rows(parse(lines("GET a=1&a=2&b", "GET a=%zz", '{"a": null, "z": 1}', "{oops"), ps))
    assert [g["event_type"] for g in got] == ["args", "rest", "json", "rest"]
    assert got[0]["a"] == "2" and got[0]["extra"] == {"b": None} and got[0]["q"] is None
    assert got[1]["q"] == "a=%zz" and got[1]["match_path"] == ["events", "args", "json", "rest"]
    assert got[2]["a"] is None and got[2]["extra"] == {"z": "1"}
    assert got[3]["j"] == "{oops"


def test_optional_group_is_null_but_empty_capture_stays(lines):
    ps = PatternSet([{"name": "t", "pattern": "a(?:=(?<opt>[a-z]*))?;(?<must>[a-z]*)"}])
    got = rows(parse(lines("a;", "a=x;y"), ps))
    assert [(g["opt"], g["must"]) for g in got] == [(None, ""), ("x", "y")]


def test_inputs_with_own_patterns(lines):
    mine = PatternSet([{"name": "mine", "pattern": "m%{INT:n}"}])
    got = rows(parse_inputs({"a": lines("m1"), "b": lines("m1")}, PatternSet(), {"a": mine}))
    assert {g["input"]: g["event_type"] for g in got} == {"a": "mine", "b": "events"}


def test_filters_are_not_copied_into_the_parse(lines):
    ps = PatternSet([{"name": "app", "pattern": "user=%{INT:u} %{JSON:j}", "fields": {"k": "int"}}])
    df = parse(lines("x"), ps).filter("u = 3 AND event_type = 'app'")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 40_000


class RowModel:
    """The matching rules, one line at a time (no structured fields)."""

    def __init__(self, specs):
        self.specs = specs

    def run(self, line):
        env, path = {"data": line}, []
        self.level(None, env, path)
        return env, path or ["events"]

    def level(self, parent, env, path):
        kids = [s for s in self.specs if (parent in s["parents"] if parent else not s["parents"])]
        for s in sorted(kids, key=lambda s: s["order"]):
            if any(env.get(f) is None or not re.fullmatch(x, env[f]) for f, x in s["cond"].items()):
                continue
            if any(env.get(f) is not None and not re.fullmatch(x, env[f]) for f, x in s["softcond"].items()):
                continue
            if env.get(s["field"]) is None:
                continue
            hit = False
            for p in s["patterns"]:
                m = re.fullmatch(p, env[s["field"]])
                if m:
                    hit = True
                    path.append(s["name"])
                    env.update(m.groupdict())
            if hit:
                self.level(s["name"], env, path)
                return


@pytest.mark.parametrize("seed", range(4))
def test_random_trees_agree_with_the_row_model(spark, seed):
    rng = random.Random(seed)
    bits = ["(?P<f1>[ab]+)x(?P<f2>[cd]*)", "(?P<f1>a[a-z]*)", "(?P<f2>[a-z]*)d", "(?P<data>[a-z]+)z", "[a-c]*x.*", "(?P<f3>.)(?P<data>.*)"]
    specs = [{"name": "events", "parents": [], "patterns": ["(?P<data>.*)"], "field": "data", "order": 1, "cond": {}, "softcond": {}}]
    for i in range(7):
        parents = sorted({rng.choice(specs)["name"] for _ in range(rng.choice([1, 1, 2]))})
        specs.append(
            {
                "name": f"t{i}", "parents": parents, "order": rng.choice([0, 0, 1, 2]),
                "patterns": rng.sample(bits, rng.choice([1, 1, 2])), "field": rng.choice(["data", "data", "f1", "f2"]),
                "cond": {"f2": "[a-z]*c[a-z]*"} if rng.random() < 0.2 else {},
                "softcond": {"f1": "a.*"} if rng.random() < 0.3 else {},
            }
        )
    texts = ["".join(rng.choice("abcdxz") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    ps = PatternSet(
        [
            {
                "name": s["name"], "parent": s["parents"], "order": s["order"], "field": s["field"], "cond": s["cond"],
                "softcond": s["softcond"], "pattern": [p.replace("(?P<", "(?<") for p in s["patterns"]],
            }
            for s in specs
        ]
    )
    model = RowModel(specs)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, data string")
    got = {r["i"]: r.asDict() for r in parse(df, ps).collect()}
    for i, text in enumerate(texts):
        env, path = model.run(text)
        assert got[i]["match_path"] == path, text
        for f in ("data", "f1", "f2", "f3"):
            if f in got[i]:
                assert got[i][f] == env.get(f), (text, f)
