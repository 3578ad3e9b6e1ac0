"""A corpus-cleaning pipeline: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each
stage's table to the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilecohort.llm.common import documents, written
from tilecohort.llm.stages import bpe_tokens, drop_benchmark_leaks, drop_near_duplicates, drop_unidentified, redact_secrets

STAGES = [
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", bpe_tokens),
]

#: Language, latent semantic and BPE stages can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
