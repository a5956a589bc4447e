"""Queries of the training-data operators, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import ann, fingerprints, jaccard, licenses, mixing, pii, quality, secret_scan, suffix_dedup, unigram
from docfields.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


#: Documents whose labels are held out of training.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no names by which to know license files, so each licensed document stands for its directory."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(licenses.document_paths(docs), license_file=F.lit(True))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), f"not ({HELD_OUT})")
    return quality.score(docs, model).selectExpr(
        "doc_id", f"coalesce({HELD_OUT}, false) held_out", "score", f"cast(score >= {quality.ACCEPT} as int) predicted"
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.samples(spark)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_sentencepiece, op3_neighbours, op4_licenses, op5_quality, op6_secret_scan, op7_mixing, op8_fingerprints, op9_jaccard, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.SQL, "op7_mixing": mixing.SQL, "op9_jaccard": jaccard.SQL}
