"""The thin queries of the numbered operators; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, dac, langid, leaks, licenses, mil, neardup, quality, runs, secrets, simhash, substrings
from .common import documents, held_out, new_path

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def op1_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs.withColumn("path", licenses.document_path(F.col("source"), F.col("doc_id"))))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_decode(docs, VOCAB, bpe.make_lexicon(docs, VOCAB))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    dac.write_shards(documents(spark, sf_dir), VOCAB, path)
    return dac.read_shards(spark.read.schema(dac.SHARDS).parquet(path))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(documents(spark, sf_dir), new_path(spark, "ledger"))


def op9_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = mil.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"))))
    return mil.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(documents(spark, sf_dir), labels.filter(~held_out(F.col("doc_id"))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.collapse(runs.with_periodic_tails(documents(spark, sf_dir))))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


QUERIES = {f.__name__: f for f in (op1_license_inheritance, op2_bpe_round_trip, op3_benchmark_leaks, op4_language_spans, op5_token_shards, op6_repeated_passages, op7_near_duplicates, op8_secret_ledger, op9_quality_attention, op10_quality_rules, op11_periodic_runs, op12_centroids, op13_simhash_groups)}


def _secret_sql() -> str:
    """The ledger's result in one statement: pieces between matches and matches themselves give the spans."""
    parts = []
    for number, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS kind, '{r.kind}' AS name, {str(r.base).lower()} AS base, string_split_regex(text, '{pattern}') AS p, "
            f"regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS v, {r.least} AS least FROM documents WHERE regexp_matches(text, '{pattern}')"
        )
    return f"""
WITH a AS ({" UNION ALL ".join(parts)}),
e AS (SELECT a.*, unnest(range(1, len(m) + 1)) AS i FROM a),
s AS (SELECT doc_id, kind, name, base, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size FROM e WHERE length(v[i]) >= least),
t AS (SELECT *, name || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (base) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


_REPEAT_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS d FROM x GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + o AS p FROM x JOIN f USING (k), (SELECT unnest(range(13)) AS o) WHERE d < doc_id),
n AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
c AS (SELECT n.doc_id, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY n.p) FILTER (r.p IS NULL) AS kept FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND n.p = r.p GROUP BY n.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN c ON w.doc_id = c.doc_id"""

def _centroid_sql(rounds: int = 10) -> str:
    """Every round in full: distances to all centroids by list arithmetic, floors of the means, and the next round."""
    nearest = "SELECT v.vec_id, v.x, arg_min(struct_pack(k := c.k, d := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))), struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), k := c.k)) AS b FROM v CROSS JOIN c{0} c GROUP BY v.n, v.vec_id, v.x"
    parts = [
        "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS y FROM embeddings WHERE len(embedding) = 64)",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(y, lambda z: floor(1024 * z)::BIGINT) AS x FROM e WHERE len(list_filter(y, lambda z: z IS NOT NULL AND isfinite(z))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v ORDER BY k LIMIT 8)",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({nearest.format(r)})",
            f"m{r} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT b.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY b.k, i) GROUP BY k)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)",
        ]
    parts.append(f"a AS MATERIALIZED ({nearest.format(rounds)})")
    named = f"SELECT k, sha256(array_to_string(x, ',')) AS h FROM c{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b.k::INT AS cluster, b.d::BIGINT AS distance, sum(b.d) OVER (PARTITION BY b.k)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a JOIN ({named}) s ON a.b.k = s.k"""


ORACLE_SQL: dict[str, str] = {"op12_centroids": _centroid_sql(), "op6_repeated_passages": _REPEAT_SQL, "op8_secret_ledger": _secret_sql()}
