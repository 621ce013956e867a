"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. ``languages`` drops documents whose language is unknown or does not win its duels.
2. ``near_duplicates`` keeps one document, that with the smallest id, of every group linked by shingles of
   five words and a Jaccard index of 0.8.
3. ``private_data`` replaces personal data by its kind in brackets; all documents stay.
4. ``mix`` draws the sources to their target weights: a row for each document and pass, with the words taken.
5. ``tokens`` encodes the mix and returns token counts and digests.

All but the last return the columns of documents.  ``n_chars`` follows the text.  An empty table passes all
stages; null texts go in the first one, as they have no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentigrade.llm import bpe, jaccard, langid, mixing, pii
from sentigrade.session import materialize


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.mixed_texts(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest_round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mix", mix),
    ("tokens", tokens),
]

# Trained models, connected components and pseudorandom draws have no SQL form; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
