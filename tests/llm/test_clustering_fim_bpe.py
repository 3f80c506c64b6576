"""Clustering, fill-in-middle and byte-pair encoding against plain Python and the library."""

import os
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from lumberline.llm import bpe, fim, ptolemy
from lumberline.llm.queries import ORACLES, QUERIES
from lumberline.llm.tokens import vocabulary_text

public_tokenizers = pytest.importorskip("public_tokenizers")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH = public_tokenizers.path("byte_bpe_50k.json")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
# Columns beside id and text have the names the operators use themselves.
DOCS = "doc_id bigint, text string, n string, form int, output string, ids string"


def texts():
    rng = random.Random(3)
    words = ["the", " ", "  ", "\n", "it's", "'s", "é", "日本", "a-b", "<", "x1", "👩‍👩‍👧", "　", "\x00", "ΟΔΟΣ", "\x1c", "½"]
    out = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(80)]
    out += ["".join(rng.choices(words, k=rng.randrange(40))) for _ in range(80)]
    out += ["", None, " ", "\n\n", "x", "a<P>b c", "<S>", "a <M", "<|endoftext|>", " a <|endoftext|>  <|endoftext|", "word " * 40_000, "x" * 70_000, " " * 70_000, "é" * 200_000 + " b"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, "a", 1, "b", "c") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[5:9], DOCS)


@pytest.mark.parametrize("positions", [
    [0], [65_535], [65_536], [0, 65_535, 65_536, 131_072], range(70_000), range(0, 300_000, 3), [5, 6, 7, 200_000, 200_001],
    sorted(random.Random(1).sample(range(400_000), 90_000)), [*range(100, 9_000), *range(70_000, 70_100, 2), *range(140_000, 200_000, 5)],
])
def test_boundary_set_selects_every_member(positions):
    found = fim.BoundarySet(np.array(positions, np.int64))
    assert len(found) == len(positions)
    assert [found.select(k) for k in range(len(found))] == list(positions)
    for k in (-1, len(found)):
        with pytest.raises(IndexError):
            found.select(k)


def test_boundary_set_uses_the_smallest_container():
    kinds = [{type(c) for c in fim.BoundarySet(np.array(x)).containers} for x in ([1, 5, 9], range(60_000), range(0, 60_000, 2))]
    assert kinds == [{fim.ArrayContainer}, {fim.RunContainer}, {fim.BitmapContainer}]


def plain_fim(doc_id, text, units):
    text = text or ""
    u = units(text)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("unit", "units"), [("words", UNITS.findall), ("characters", list)])
def test_fill_in_middle_against_plain_python(spark, docs, unit, units):
    made = fim.fill_in_middle(docs, unit=unit)
    back = made.withColumn("back", fim.restored("output", "form")).collect()
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r)[:6] for r in back], key=repr) == sorted([plain_fim(i, t, units) for i, t in pairs], key=repr)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert sorted((r.doc_id or 0, r.back) for r in back) == sorted((i or 0, t or "") for i, t in pairs)
    assert fim.fill_in_middle(docs.limit(0), unit=unit).collect() == []


def test_sentinels_that_overlap_are_refused(docs):
    with pytest.raises(ValueError, match="sentinels"):
        fim.fill_in_middle(docs, sentinels=("ab", "bc", "x"))


def test_codec_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(vocabulary_text(PATH))
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, b"".join(x.to_bytes(4, "little") for x in ids), lib.decode(ids, skip_special_tokens=False)))
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in got], key=repr) == sorted(want, key=repr)
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_codec_with_a_memo_that_is_always_full():
    from tokenizers import Tokenizer

    vocabulary = vocabulary_text(PATH)
    lib, small = Tokenizer.from_str(vocabulary), bpe.Codec(vocabulary, size=2)
    for text in texts():
        if len(text or "") < 10_000:
            ids = small.encode(text or "")
            assert memoryview(ids).cast("I").tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_decoding_ids_that_are_no_text():
    codec = bpe.codec(vocabulary_text(PATH))
    broken = codec.of_byte[0xE6].to_bytes(4, "little") + codec.of_byte[0x41].to_bytes(4, "little") + (10**6).to_bytes(4, "little")
    assert codec.decode(broken) == "�A"


def plain_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        centroids = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    of = [sum(d for _, d, j in found if j == c) for c in range(len(centroids))]
    return sorted([(i, j, d, of[j], sum(of), centroids[j]) for i, d, j in found], key=repr)


SHAPE = "vec_id bigint, embedding array<double>, label int, cluster string, distance string, point string, cached string"


@pytest.mark.parametrize("spread", [0.001, 1.0, 50.0])
def test_clusters_equal_plain_python(spark, spread):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in rng.normal(size=6) * spread + (i % 3)]) for i in range(300)]
    vectors += vectors[:20] + [(1000 + i, vectors[0][1]) for i in range(30)]  # repeated rows, equal vectors
    vectors += [(None, vectors[1][1]), (2000, None), (2001, [1.0] * 5), (2002, [1.0] * 5 + [None]), (2003, [float("nan")] * 6), (2004, [float("-inf")] * 6), (2005, [])]
    df = spark.createDataFrame([(i, v, 1, "c", "d", "p", "x") for i, v in vectors], SHAPE)
    got = ptolemy.cluster(df, k=5, rounds=4, dim=6, scale=1024, seed=3, n_pivots=4)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_clusters(vectors, 5, 4, 6, 1024, 3)


def test_clusters_of_few_equal_or_no_rows(spark):
    none = ptolemy.cluster(spark.createDataFrame([], SHAPE), dim=2)
    assert none.collect() == [] and none.columns[:3] == ["vec_id", "cluster", "distance"]
    same = [(i, [0.5, -0.5]) for i in range(4)]
    got = ptolemy.cluster(spark.createDataFrame([(*r, 1, "", "", "", "") for r in same], SHAPE), dim=2)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_clusters(same, 8, 10, 2, 1024, 3)


def test_components_that_may_overflow_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 1, "", "", "", "")], SHAPE)
    with pytest.raises(Exception, match="64 bits"):
        ptolemy.cluster(df, dim=2).collect()


def test_pruning_measures_less_and_bounds_hold():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, size=(8, 64))
    x = np.concatenate([c + rng.integers(-60, 60, size=(200, 64)) for c in centres])
    pivots = ptolemy.Pivots(centres[:5])
    nearest = ptolemy.Nearest(centres, pivots)
    cached = pivots.distances(x)
    exact = ptolemy.squares(x, centres)
    assert (nearest.bounds(cached) <= np.sqrt(exact)).all()
    best, square, measured = nearest(x, cached)
    assert (best == exact.argmin(axis=1)).all() and (square == exact.min(axis=1)).all()
    assert measured < 2 * len(x)


@pytest.mark.parametrize("key", ["op11_centroid_clustering", "op12_fill_in_middle"])
def test_queries_equal_their_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    got = QUERIES[key](spark, folder).select(*names).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want.fetchall(), key=repr)
    assert got
