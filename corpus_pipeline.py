"""The corpus pipeline: five training-data operators applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All but the last return the columns
of ``docs``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docfields.llm import jaccard, mixing, pii, quality, unigram
from docfields.llm.base import cut, table
from docfields.llm.entry import HELD_OUT


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough; the classifier learns from labels that are not held out."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels"), f"not ({HELD_OUT})"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_each(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return unigram.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", one_of_each),
    ("pii", mask_personal),
    ("mixing to target weights", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
