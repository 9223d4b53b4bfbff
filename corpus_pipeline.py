"""From raw documents to packed training windows, in five stages.

1. language: documents without a recognised language go (no letters, or no
   language with more than even odds).
2. near_duplicates: of documents linked by five-word shingles with a Jaccard
   similarity of 0.8 or more, the one with the smallest doc_id stays (null ones
   come last; of equal ones it is that whose text has the smallest hash).
3. repeated_spans: passages that stand earlier in the corpus are cut out; a
   document of which nothing is left goes.
4. secrets: secrets are masked in the text.
5. packing: the tokens are packed into windows of 2048.

A stage gets what its predecessor kept, as a written table with the columns of
``documents`` and any others that it had; n_chars follows the text. Rows with a
null text go in stage 1. Rows are told apart by doc_id and text, never by doc_id
alone, so null and repeated identifiers do no harm. Empty tables give no rows. SQL cannot express the encoders and models, so there
is no ORACLE_SQL; the stages' operators are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkspur.llm import langid

    judge = langid.predictor(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select(F.struct("*").alias("row"), judge(F.col("text")).alias("found"))
    rows = rows.where("found.lang_pred != 'und' and found.score > 0.5")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkspur.llm import jaccard

    return jaccard.one_of_each(docs, k=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkspur.llm import chunks

    left = chunks.remove_spans(docs, chunks.repeated_spans(docs))
    return _with_length(left.where(F.length(F.trim("text")) > 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkspur.llm import secrets

    return _with_length(secrets.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkspur.llm import packing

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("secrets", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. Each stage's table goes to the shared checkpoint
    folder and is deleted once its successor is written; the last one stays, as the
    result reads it."""
    from larkspur.llm.common import remove_written, written

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove_written(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
