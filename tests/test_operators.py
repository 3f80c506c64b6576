"""Operators against brute force, with one key that owns a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from lumberline.functions import net
from lumberline.functions.text import csv_values, url_map, url_multi_map, url_pairs
from lumberline.operators import aggregates, chunked, joins, sequence, windows
from lumberline.operators.lookup import cidr_join, cidr_join6, lookup_join, not_listed, only_listed

N = 600


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows, used = [], set()
    for i in range(N):
        t = rng.randrange(0, 5000)
        while t in used:
            t = rng.randrange(0, 5000)
        used.add(t)
        key = None if i % 29 == 0 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}")
        rows.append((i, key, t - 1000, rng.randrange(100), rng.choice("abc")))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id int, key string, t long, v int, kind string")


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: r[2]):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("width", [7, 250, 100_000])
def test_sequence_and_running(df, data, width):
    want = {}
    for rows in by_key(data).values():
        total, high, before = 0, -1, None
        for n, r in enumerate(rows, 1):
            total, high = total + r[3], max(high, r[3])
            want[r[0]] = (n, total, high, before)
            before = r[2]
    out = chunked.sequence_number(df, ["key"], "t", width=width)
    out = chunked.running(out, ["key"], "t", sums={"total": F.col("v")}, maxima={"high": F.col("v")}, width=width)
    out = chunked.previous_position(out, ["key"], "t", "before", width=width)
    got = {r.id: (r.seq, r.total, r.high, r.before) for r in out.collect()}
    assert got == want


def test_no_key_at_all(df, data):
    rows = sorted(data, key=lambda r: r[2])
    out = chunked.sequence_number(df, [], "t", width=100)
    assert {r.id: r.seq for r in out.collect()} == {r[0]: n for n, r in enumerate(rows, 1)}


@pytest.mark.parametrize("include", [True, False])
def test_carry_last(df, data, include):
    want = {}
    for rows in by_key(data).values():
        last = None
        for r in rows:
            now = r[3] if r[4] == "a" else None
            want[r[0]] = (now if now is not None else last) if include else last
            last = now if now is not None else last
    out = chunked.carry_last(df, ["key"], "t", F.when(F.col("kind") == "a", F.col("v")), "last", width=40, include_current=include)
    assert {r.id: r.last for r in out.collect()} == want


def test_frames(df, data):
    want = {}
    for rows in by_key(data).values():
        for i, r in enumerate(rows):
            recent = [x for x in rows if r[2] - 60 < x[2] <= r[2]]
            want[r[0]] = (len(recent), sum(x[3] for x in recent), sum(x[3] for x in rows[max(0, i - 2):i + 1]))
    out = chunked.over_range(df, ["key"], "t", 60, {"n": F.count("*"), "s": F.sum("v")}, width=60)
    out = chunked.over_rows(
        out, ["key"], "t", lambda w: {"three": F.sum("v").over(w.rowsBetween(-2, 0))}, back=2, width=50, rows_per_chunk=5
    )
    assert {r.id: (r.n, r.s, r.three) for r in out.collect()} == want


def test_sessions(df, data):
    want = set()
    for key, rows in by_key(data).items():
        run = [rows[0]]
        for r in rows[1:]:
            if r[2] - run[-1][2] >= 30:
                want.add((key, run[0][2], run[-1][2], len(run)))
                run = []
            run.append(r)
        want.add((key, run[0][2], run[-1][2], len(run)))
    out = windows.sessions(df, ["key"], "t", 30, sums={"n": F.lit(1)}, width=64)
    assert {(r.key, r.session_start, r.session_end, r.n) for r in out.collect()} == want


def sides(df):
    a = df.filter("kind = 'a'").select(F.col("id").alias("a"), F.col("key").alias("x"), F.col("t").alias("ta"))
    b = df.filter("kind = 'b'").select(F.col("id").alias("b"), F.col("key").alias("y"), F.col("t").alias("tb"))
    return a, b


def plain_sides(data):
    return [r for r in data if r[4] == "a"], [r for r in data if r[4] == "b"]


def test_interval_joins(df, data):
    a, b = sides(df)
    pa, pb = plain_sides(data)
    pairs = {(x[0], y[0]) for x in pa for y in pb if x[1] and x[1] == y[1] and x[2] - 50 < y[2] <= x[2]}
    got = joins.interval_join(a, b, [("x", "y")], "ta", "tb", 50)
    assert {(r.a, r.b) for r in got.collect()} == pairs
    two = {(x[0], y[0]) for x in pa for y in pb if x[1] and x[1] == y[1] and abs(x[2] - y[2]) < 50}
    got = joins.interval_join(a, b, [("x", "y")], "ta", "tb", 50, 50)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(two)
    lone_a = {(x[0], None) for x in pa} - {(p, None) for p, _ in pairs}
    lone_b = {(None, y[0]) for y in pb} - {(None, p) for _, p in pairs}
    full = joins.interval_outer_join(a, b, [("x", "y")], "ta", "tb", 50, "full")
    assert {(r.a, r.b) for r in full.collect()} == pairs | lone_a | lone_b


@pytest.mark.parametrize("widest", [10**9, 1])
@pytest.mark.parametrize("ahead", [False, True])
def test_nearest(df, data, ahead, widest):
    a, b = sides(df)
    pa, pb = plain_sides(data)
    want = {}
    for x in pa:
        near = [y for y in pb if x[1] and x[1] == y[1] and (x[2] < y[2] < x[2] + 80 if ahead else x[2] - 80 < y[2] <= x[2])]
        near.sort(key=lambda y: abs(y[2] - x[2]))
        want[x[0]] = near[0][0] if near else None
    out = joins.nearest_in_range(a, b, [("x", "y")], "ta", "tb", 80, ["b"], ahead, widest_slot_us=widest)
    assert {r.a: r.b for r in out.collect()} == want


def test_as_of_and_range_join(spark, df, data):
    a, b = sides(df)
    pa, pb = plain_sides(data)
    want = {}
    for x in pa:
        near = [y for y in pb if x[1] and x[1] == y[1] and y[2] <= x[2]]
        want[x[0]] = max(near, key=lambda y: y[2])[0] if near else None
    out = joins.last_value_join(a, b, [("x", "y")], "ta", "tb", ["b"], width=90)
    assert {r.a: r.b for r in out.collect()} == want
    bands = spark.createDataFrame([(0, -50, 30), (1, 20, 77), (2, 77, 78), (3, 5, 5)], "band int, lo long, hi long")
    got = joins.range_join(df.withColumn("w", F.col("v").cast("long")), bands, "w", "lo", "hi", 10)
    ranges = [(0, -50, 30), (1, 20, 77), (2, 77, 78)]
    assert sorted((r.id, r.band) for r in got.collect()) == sorted(
        (r[0], n) for r in data for n, lo, hi in ranges if lo <= r[3] < hi
    )


def test_distribution(df, data):
    import statistics as st

    got = {r.key: r for r in aggregates.distribution(df, ["key"], "v", width=10).collect()}
    for key, rows in by_key(data).items():
        vals = [r[3] for r in rows]
        g = got[key]
        assert g.n == len(vals) and g.median == st.median(vals)
        assert g.stddev == pytest.approx(st.stdev(vals)) and g.mean == pytest.approx(st.mean(vals))
        assert g.avedev == pytest.approx(sum(abs(v - st.mean(vals)) for v in vals) / len(vals))


def test_batches_matches_and_contexts(df, data):
    import re

    batches, starts, ctx = set(), set(), {}
    for key, rows in by_key(data).items():
        for i in range(0, len(rows) - 4, 5):
            batches.add((key, i // 5, sum(r[3] for r in rows[i:i + 5])))
        text = "".join(r[4] for r in rows)
        for i in range(len(rows)):
            m = re.match("ab{1,2}c", text[i:i + 4])
            if m:
                starts.add((rows[i][0], len(m.group()), rows[i + len(m.group()) - 1][0]))
        active, n = False, 0
        for r in rows:
            if r[4] == "a" and not active:
                active, n = True, n + 1
            if active:
                ctx.setdefault((key, n), []).append(r[0])
            if r[4] == "c":
                active = False
    out = windows.length_batch(df, ["key"], "t", 5, [F.sum("v").alias("s")])
    assert {(r.key, r.batch, r.s) for r in out.collect()} == batches
    for pattern, longest in (("ab+c", 4), ("ab{1,2}c", 3), ("ab(?=c)", 4)):
        with pytest.raises(ValueError, match="row pattern"):
            sequence.match_rows(df, ["key"], "t", F.col("kind"), pattern, longest, "id")
    out = sequence.match_rows(df, ["key"], "t", F.col("kind"), "ab{1,2}c", 4, "id")
    assert {(r.id, r.match_length, r.last_id) for r in out.collect()} == starts
    out = sequence.contexts(df, ["key"], "t", F.col("kind") == "a", F.col("kind") == "c", width=33)
    got = {}
    for r in out.collect():
        got.setdefault((r.key, r.context), []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ctx.items()}


def test_lookups(spark, df, data):
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, rank int")
    joined = lookup_join(df, table, [("key", "key")])
    assert joined.columns == [*df.columns, "rank"] and joined.count() == N
    hot = sum(1 for r in data if r[1] in ("hot", "k1"))
    assert only_listed(df, table, [("key", "key")]).count() == hot
    assert not_listed(df, table, [("key", "key")]).count() == N - hot


def test_cidr_takes_the_longest_prefix_once(spark):
    nets = spark.createDataFrame(
        [("0.0.0.0/0", "all"), ("10.0.0.0/8", "ten"), ("10.1.0.0/16", "sixteen"), ("10.1.2.0/24", "small"), ("10.1.2.0/24", "twin")],
        "network string, name string",
    )
    ips = ["10.1.2.3", "10.1.9.9", "10.200.0.1", "9.9.9.9", "nonsense", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    got = {r.i: r.name for r in cidr_join(df, "ip", nets, ["name"]).collect()}
    assert got == {0: "small", 1: "sixteen", 2: "ten", 3: "all", 4: None, 5: None}


def test_ipv6_networks(spark):
    import ipaddress

    texts = ["::/0", "2000::/3", "2001:db8::/32", "2001:db8:8000::/33", "2001:db8:8000::1/127", "2a00::/21", "2001:d00::/25"]
    nets = spark.createDataFrame([(t, f"n{i}") for i, t in enumerate(texts)], "network string, name string")
    ips = ["2001:db8::1", "2001:db8:9000::", "2001:db8:8000::", "2001:db8:8000::2", "2a00:7ff::1", "2a00:800::1", "fe80::1", "2001:d7f::9", "1.2.3.4", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    want = {}
    for i, ip in enumerate(ips):
        inside = [
            (ipaddress.ip_network(t, strict=False).prefixlen, f"n{n}")
            for n, t in enumerate(texts)
            if ip and ":" in ip and ipaddress.ip_address(ip) in ipaddress.ip_network(t, strict=False)
        ]
        want[i] = max(inside)[1] if inside else None
    assert {r.i: r.name for r in cidr_join6(df, "ip", nets, ["name"]).collect()} == want


def test_addresses_agree_with_the_standard_library(spark):
    import ipaddress

    texts = [
        "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "", "::", "::1", "2001:db8::8:800:200c:417a",
        "fe80::1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:10.1.2.3", "12345::1", "g::1", "1:2:3:4:5:6:7::",
        "2001:DB8::1", "::ffff:10.1.2.300",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = df.select("ip", net.ip4_number(F.col("ip")).alias("n"), net.ip6_hex(F.col("ip")).alias("h"),
                    net.ipin(F.col("ip"), "2001:db8::/32", "1.0.0.0/8").alias("inside")).collect()
    for r in got:
        try:
            a = ipaddress.ip_address(r.ip)
        except ValueError:
            a = None
        assert r.n == (int(a) if a is not None and a.version == 4 else None), r.ip
        assert r.h == (f"{int(a):032x}" if a is not None and a.version == 6 else None), r.ip
        nets = [ipaddress.ip_network("2001:db8::/32"), ipaddress.ip_network("1.0.0.0/8")]
        assert r.inside == (a is not None and any(a in n for n in nets)), r.ip


def test_private_addresses_and_ranges(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.1.2.3/8"), ("8.8.8.8", "8.8.8.8"), ("", "x/8"), (None, "1.2.3.4/33"), ("bad", None)], "ip string, n string")
    ip = F.col("ip")
    got = [tuple(r) for r in df.select(net.isprivateip(ip), net.notprivateip(ip), net.netrange(F.col("n"))["lo"], net.netrange(F.col("n"))["hi"]).collect()]
    assert got == [
        (True, False, "10.0.0.0", "10.255.255.255"), (False, True, "8.8.8.8", "8.8.8.8"), (False, False, None, None),
        (False, False, None, None), (False, True, None, None),
    ]


def test_url_and_csv_text(spark):
    df = spark.createDataFrame([("a=1&b=%20x+y&a=2&&=z&c=&d&&",), ("&&",), ("",)], "q string")
    pairs = url_pairs(F.col("q"))
    first, second, third = df.select(url_map(pairs).alias("m"), url_multi_map(pairs).alias("mm")).collect()
    assert first.m == {"a": "2", "b": " x y", "": None, "=z": None, "c": None, "d": None}
    assert first.mm["a"] == ["1", "2"]
    assert second.m == {} and third.m == {"": None}
    rows = spark.createDataFrame([('1,"a,b",',), ("x",), ("1,2,3,4",), ("",)], "c string")
    assert [r[0] for r in rows.select(csv_values(F.col("c"), 3)).collect()] == [
        ["1", "a,b", ""], ["x", None, None], ["1", "2", "3"], ["", None, None],
    ]


def test_upsert_and_split(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(2, 1, "x"), (2, 2, None), (3, 1, "DEL"), (4, 5, "new")], "k int, n int, v string")
    out = sequence.upsert(base, changes, "k", "n", ["v"], F.coalesce(F.col("v") == "DEL", F.lit(False)))
    assert {(r.k, r.v) for r in out.collect()} == {(1, "a"), (2, None), (4, "new")}
    routed = sequence.split_stream(base, {"one": F.col("k") == 1, "low": F.col("k") < 3}, otherwise="rest")
    assert {r.k: r.target for r in routed.collect()} == {1: "one", 2: "low", 3: "rest"}
