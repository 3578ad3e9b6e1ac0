"""The stages of the corpus pipeline; all but the last return the columns of their input.

Each takes (spark, docs, sf_dir). An empty table stays empty, other columns pass through whatever their
names, repeated rows are judged alike, and a null text has no letter, no shingle, no item and no secret: only the
language stage drops it. Rows with a null doc_id are kept by the near-duplicate stage.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, leaks, neardup, secrets
from .common import documents, held_out, new_path, numbered, small_batches
from .queries import VOCAB

#: A document stays if its language is known with this score at least.
LEAST_LANGUAGE_SCORE = 0.5


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those no language of which reaches LEAST_LANGUAGE_SCORE."""
    model = langid.learn(documents(spark, sf_dir).filter(~held_out(F.col("doc_id"))))
    plain, names = numbered(docs)
    found = langid.identify(plain, model, names["doc_id"], names["text"], keep=[c for c in plain.columns if c != names["doc_id"]])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    small_batches(spark)
    gone = neardup.groups(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text."""
    clean = secrets.redact(docs, new_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    small_batches(spark)
    return bpe.encode_decode(docs.select("doc_id", "text"), VOCAB, bpe.make_lexicon(docs.select("text"), VOCAB))
