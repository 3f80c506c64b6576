"""Networks of both families against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lumberline.functions import net
from lumberline.operators import lookup


def made_networks(rng, n):
    out = ["::/0", "2000::/3", "0.0.0.0/0", "10.0.0.0/8", "10.255.0.0/16", "10.255.255.255/32", "ffff::/16", "255.0.0.0/8"]
    for _ in range(n):
        if rng.random() < 0.5:
            base = ipaddress.IPv4Address((10 << 24) | rng.randrange(1 << 16) << 8 | rng.randrange(256))
            out.append(f"{base}/{rng.choice([9, 12, 15, 16, 20, 23, 24, 27, 31, 32])}")
        else:
            base = ipaddress.IPv6Address((0x20010DB8 << 96) | rng.randrange(1 << 12) << 84 | rng.randrange(1 << 20))
            out.append(f"{base}/{rng.choice([29, 33, 36, 41, 44, 48, 64, 109, 120, 127, 128])}")
    return out


def addresses(rng, nets):
    out = [None, "", "x", "1.2.3", "::g", "0.0.0.0", "255.255.255.255", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    for text in rng.sample(nets, min(len(nets), 150)):
        n = ipaddress.ip_network(text, strict=False)
        for value in (int(n[0]) - 1, int(n[0]), int(n[-1]), int(n[-1]) + 1, rng.randrange(int(n[0]), int(n[-1]) + 1)):
            if 0 <= value < 2**n.max_prefixlen:
                out.append(str(type(n[0])(value)))
    return out


@pytest.mark.parametrize(("n", "points"), [(0, 1024), (300, 1024), (300, 7)])
def test_longest_match_in_nested_networks(spark, monkeypatch, n, points):
    monkeypatch.setattr(lookup, "BLOCK_POINTS", points)
    rng = random.Random(n)
    texts = made_networks(rng, n)
    ips = addresses(rng, texts)
    rows = [(t, f"n{i:04d}") for i, t in enumerate(texts)] + [("10.0.0.0/8", "n0000a"), ("bad", "x"), ("1.2.3.4/33", "x"), (None, "x")]
    nets = spark.createDataFrame(rows, "network string, name string")
    df = spark.createDataFrame([(i, ip, "own") for i, ip in enumerate(ips)], "i int, ip string, point string")
    first = {}
    for text, name in rows:
        try:
            key = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        first[key] = min(name, first.get(key, name))
    want = {}
    for i, ip in enumerate(ips):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            a = None
        inside = [(k.prefixlen, v) for k, v in first.items() if a is not None and a.version == k.version and a in k]
        want[i] = max(inside)[1] if inside else None
    joined = lookup.cidr_join(df, "ip", nets, ["name"])
    assert joined.columns == ["i", "ip", "point", "name"]
    assert {r.i: r.name for r in joined.collect()} == want


def test_no_networks_at_all(spark):
    nets = spark.createDataFrame([], "network string, name string")
    df = spark.createDataFrame([(1, "1.2.3.4"), (2, None)], "i int, ip string")
    assert [r.name for r in lookup.cidr_join(df, "ip", nets, ["name"]).collect()] == [None, None]


def test_blocks_are_of_about_equal_size_however_bunched(spark, monkeypatch):
    """A single /32 holds all networks; no block holds much more than its share."""
    monkeypatch.setattr(lookup, "BLOCK_POINTS", 100)
    nets = spark.range(4000).select(F.concat(F.lit("2001:db8:1:"), F.lower(F.hex("id")), F.lit("::/64")).alias("network"), F.col("id").alias("n"))
    blocks, points = lookup.range_blocks(*lookup.disjoint_ranges(nets, ["n"]))
    sizes = [r[0] for r in blocks.select(F.size("__points")).collect()]
    assert sum(sizes) == 8000 and len(sizes) == len(points) > 60 and max(sizes) <= 2 * 100


def test_ranges_and_membership_by_column(spark):
    rng = random.Random(9)
    texts = made_networks(rng, 200) + ["1.2.3.4", "2001:db8::7", "1:0:0:2:0:0:0:3/128", "0:0:1::/48", "1:2:3:4:5:6:7:8/127", "fe80::/10", "bad", "", None, "1.2.3.4/33", "::/129", "1.2.3.4/-1", "1.2.3.4/x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, network string")
    for r in df.withColumn("r", net.netrange(F.col("network"))).collect():
        try:
            n = ipaddress.ip_network(r.network, strict=False)
        except ValueError:
            assert r.r is None, r
            continue
        four = n.version == 4
        assert (r.r.lo, r.r.hi) == (str(n[0]), str(n[-1])), r
        assert (r.r.lo_num, r.r.hi_num) == ((int(n[0]), int(n[-1])) if four else (None, None))
    pairs = [(ip, t) for t in texts for ip in rng.sample(addresses(random.Random(1), texts[:100]), 3)]
    df = spark.createDataFrame(pairs, "ip string, network string")
    for r in df.withColumn("inside", net.ipin_column(F.col("ip"), F.col("network"))).collect():
        try:
            a, n = ipaddress.ip_address(r.ip), ipaddress.ip_network(r.network, strict=False)
        except ValueError:
            assert r.inside is False
            continue
        assert r.inside == (a.version == n.version and a in n), r
