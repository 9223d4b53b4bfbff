"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, counts, fingerprints, jaccard, langid, neighbours, packing, pii, secrets
from .common import table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(docs, path, keep=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", langid.in_held_out("doc_id"))
    return langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "held_out"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = counts.count_tokens(docs, path, keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_fingerprints": op2_fingerprints,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "pipeline": pipeline,
}

ORACLES = {"op2_fingerprints": fingerprints.EDIT_REPORT_SQL, "op9_secret_scan": secrets.REPORT_SQL}
