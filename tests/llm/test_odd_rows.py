"""Long and odd texts, and columns with the names the operators use."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from lumberline.llm import neardup, secretscan, substrings, surrogates

public_tokenizers = pytest.importorskip("public_tokenizers")
SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, rows, extra="score string, secrets int, text_ string, of_id int"):
    names = len(extra.split(","))
    return spark.createDataFrame([(i, t, *["1", 2, "3", 4][:names]) for i, t in rows], f"doc_id bigint, text string, {extra}")


def test_nul_is_part_of_a_word(spark):
    words = [f"a\x00b{i}" if i % 3 else f"w{i}\x00" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[:40]) + " y"), (3, " ".join(words[:59]).replace("\x00", " ")), (4, "\x00 \x00\x00 " * 30)]
    got = {r.doc_id: r for r in substrings.without_repeats(frame(spark, rows), window=20).collect()}
    seen, removed = set(), {}
    for i, t in rows:
        found, gone = re.findall(SPACE, t), set()
        for k in range(len(found) - 19):
            window = tuple(found[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        removed[i] = (len(found), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(found) if k not in gone).encode()).hexdigest())
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == removed
    shingles = {i: len({tuple(re.findall(SPACE, t)[k : k + 5]) for k in range(len(re.findall(SPACE, t)) - 4)}) for i, t in rows}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert {i: n for i, (n, _) in near.items()} == shingles and len({c for _, c in near.values()}) == 4


def test_pipeline_leaves_columns_of_any_name_alone(spark, tmp_path):
    import corpus_pipeline

    names = ["score", "secrets", "_text", "_id", "_rules", "_gone", "gone", "text_", "of_id", "of_rules", "score_", "label", "kept", "n_chars"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (" token = abcdef0123" if i == 3 else "")) for i in range(1, 8)] + [(8, None)]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", n_chars bigint"
    docs = spark.createDataFrame([(i, t, *[f"{n}-{i}" for n in names[:-1]], 5) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    for r in kept.collect():
        assert [r[n] for n in names[:-1]] == [f"{n}-{r.doc_id}" for n in names[:-1]]
        if r.doc_id == 3:
            assert r.text.endswith("[SECRET]") and r.n_chars == len(r.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 8


def plain_spans(text):
    out = []
    for number, rule in enumerate(secretscan.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.secret]) >= rule.least:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def plain_masked(text):
    out, at = "", 0
    for start, _, end in plain_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_secrets_of_long_and_odd_texts(spark):
    a, b = "0123456789abcdef" * 2, "token=AKIA" + "Z9" * 20
    texts = [
        a, f"x {a}", f"{a} x", f"é{a}é{b}é", f"password: {a} {b}", b * 3, "日" * 8191 + f" {a} " + "本" * 8190 + f" {b}",
        "y" * 8192 + a, "y" * 8160 + a, "y" * 30_000 + f" {a} " + "z" * 40_000 + f"\n{a}\n", f"{a} " * 2_000, f"secret={a} " * 1_100, "", None, "no secret",
    ]
    df = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: [tuple(s) for s in r.found] for r in secretscan.secret_spans(df, name="found").collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(texts)}
    masked = secretscan.redacted(df)
    assert masked.columns == df.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {i: t and plain_masked(t) for i, t in enumerate(texts)}


def test_a_hundred_thousand_secrets_in_one_text(spark):
    text = ("ab12" * 8 + " é ") * 100_000
    started = time.time()
    df = frame(spark, [(1, text)])
    row = secretscan.redacted(df).select("text").first()
    assert row.text == "[SECRET] é " * 100_000
    assert secretscan.secret_report(df).select("n_hex").first()[0] == 100_000
    assert time.time() - started < 60


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 1024, 3000])
def test_earlier(spark, size):
    values = [(i * 7919) % 101 for i in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    total, largest = df.select(secretscan.earlier(F.col("v"), lambda a, b: a + b), secretscan.earlier(F.col("v"), F.greatest)).first()
    assert total == [sum(values[:i]) for i in range(size)]
    assert largest == [max([0, *values[:i]]) for i in range(size)]


def test_surrogates_in_long_runs(spark):
    texts = ["x@" + "a." * 20_000 + "org", "ы" * 1_000_000, "a" * 500_000 + "@", "@" * 100_000, "1" * 300_000 + " +49 30 1234567", "x@" + "a" * 500_000]
    started = time.time()
    got = {r.doc_id: r for r in surrogates.with_surrogates(frame(spark, list(enumerate(texts))), "key").collect()}
    assert time.time() - started < 120
    assert got[0].n_replaced == 1 and got[0].text.endswith(".org") and got[0].text != texts[0]
    assert [got[i].n_replaced for i in (1, 2, 3, 5)] == [0] * 4 and all(got[i].text == texts[i] for i in (1, 2, 3, 5))
    assert got[4].n_replaced == 1 and re.fullmatch(r"1+ \+49 \d\d \d{7}", got[4].text)


@pytest.mark.parametrize("code", ["1", "7", "20", "49", "44", "358", "372", "420", "971"])
def test_country_codes_stay(spark, code):
    text = f"call +{code} 555 123 4567 now, or +{code}-555-1234567"
    out = surrogates.with_surrogates(frame(spark, [(1, text)]), "key").first().text
    found = re.fullmatch(rf"call \+{code} (\d{{3}}) (\d{{3}}) (\d{{4}}) now, or \+{code}-(\d{{3}})-(\d{{7}})", out)
    assert found and found[1] + found[2] + found[3] == found[4] + found[5] != "5551234567"


def test_names_with_hyphens_and_apostrophes(spark):
    text = "Mrs Anna-Maria Berg met Mr. O'Neil and Frau BERG-ÖZ, then Mr O’Neil."
    out = surrogates.with_surrogates(frame(spark, [(1, text)]), "key").first()
    assert out.n_replaced == 4
    for name in ("Anna", "Maria", "Berg", "BERG", "Neil", "ÖZ"):
        assert name not in out.text
    assert re.fullmatch(r"Mrs \w+ \w+ met Mr\. \w+ and Frau [A-Z]+, then Mr \w+\.", out.text)


def test_an_address_right_behind_another_match(spark):
    out = surrogates.with_surrogates(frame(spark, [(1, "4111 1111 1111 1111bob@mail.example.org")]), "key").first()
    assert out.n_replaced == 2 and "bob" not in out.text
