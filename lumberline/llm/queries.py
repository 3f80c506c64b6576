"""Registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import (
    bpe,
    fim,
    fmindex,
    neardup,
    packing,
    ptolemy,
    secretscan,
    sharding,
    spotsigs,
    substrings,
    surrogates,
    tokencount,
    toxicity,
)
from lumberline.llm.store import importable
from lumberline.queries.base import table
from lumberline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
SURROGATE_KEY = "key of this corpus"


def query(fn=None, *, sql: str | None = None):
    """Register a query under its function's name, with the SQL that states what it must return."""
    if fn is None:
        return lambda fn: query(fn, sql=sql)

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return run


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096)


@query
def op9_token_counts(spark, sf_dir):
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_document_fingerprints(spark, sf_dir):
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents"), window=20)


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii_surrogates(spark, sf_dir):
    found = surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return found.select("doc_id", "text", "n_replaced")


@query
def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


@query
def op7_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op8_decontamination(spark, sf_dir):
    return fmindex.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)


@query
def op10_secret_scans(spark, sf_dir):
    return secretscan.secret_report(table(spark, sf_dir, "documents"))


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds one after another, each over the stated vectors."""

    def nearest(c: int) -> str:
        square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return f"""a{c} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
          FROM (SELECT v.*, c.cluster, {square} AS d FROM v CROSS JOIN c{c} c) GROUP BY r)"""

    def means(c: int) -> str:
        return f"""m{c} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, (sum(e)::HUGEINT - ((sum(e)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS m
            FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{c}) GROUP BY cluster, i) GROUP BY cluster),
          c{c + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x)::BIGINT[] AS x FROM c{c} c LEFT JOIN m{c} m USING (cluster))"""

    steps = [f"{nearest(c)}, {means(c)}" for c in range(rounds)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
         c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT 8)),
         {", ".join(steps)}, {nearest(rounds)}, s AS (SELECT cluster, sum(distance) AS n FROM a{rounds} GROUP BY 1)
       SELECT a.vec_id, a.cluster, a.distance, s.n::BIGINT AS cluster_inertia, (SELECT sum(n) FROM s)::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
       FROM a{rounds} a JOIN s USING (cluster) JOIN c{rounds} c USING (cluster)"""


@query(sql=_clustering_sql())
def op11_centroid_clustering(spark, sf_dir):
    found = ptolemy.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


_FIM_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
  n AS (SELECT *, len(units)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
  p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


@query(sql=_FIM_SQL)
def op12_fill_in_middle(spark, sf_dir):
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"),
    )


@query
def op13_byte_pair_encoding(spark, sf_dir):
    path = public_tokenizers.path(BYTE_TOKENIZER)
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
