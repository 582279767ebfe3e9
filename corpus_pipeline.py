"""Corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import byte_bpe, mixing, near_dups, secrets, toxicity
from kerbside.llm.common import Steps, let_workers_import, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; all others stay as they are."""
    let_workers_import(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity of 0.8 or more)."""
    let_workers_import(spark)
    return near_dups.one_of_each_group(docs, width=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    let_workers_import(spark)
    masked = secrets.mask(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, whole, cut at the ends of a run, or not at all."""
    return mixing.mixed_documents(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and their number in place of the text; the digest of the bytes that the ids
    decode to, and whether these are the text's own."""
    let_workers_import(spark)
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ids="ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Hashes, the fitted models and the merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    steps = Steps(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = steps.keep(stage(spark, docs, sf_dir), f"stage_{name}")
        if place:
            steps.drop(f"stage_{STAGES[place - 1][0]}")
    return docs
