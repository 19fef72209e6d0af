"""From documents to token sequences: language, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of documents.

Defined results: texts of any length are worked through whole; rows without an id are rows like others, but near_dedup keeps them; rows that repeat
an id and text stay or go together; an empty table gives an empty one. language lets go of null and empty texts, and of those without a letter; the
stages after it take them as the operators say: as no copies, not contaminated, without secrets, and as an end token alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, langid, minhash, packing, secrets
from claimloom.llm.base import table
from claimloom.llm.queries import language_model, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter, or near-equal scores for all languages) go."""
    return langid.accept(docs, language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return minhash.first_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; so does none that only holds a short passage in a long text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    out = secrets.redact(docs, secrets.train(secrets.samples(spark)))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmarks), ("secrets", without_secrets), ("packing", sequences)]

#: The classifier, MinHash and the tokenizer are beyond SQL; the stages and run() are tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.base import keep

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
