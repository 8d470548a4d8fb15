"""A corpus from raw documents: quality, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bpe, mixing, near_dup, resample
from wardline.llm.common import cut, table
from wardline.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    return resample.select(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, and all without an id."""
    return near_dup.keep_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document is there as often as it is taken."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count, and the hashes of its ids and of what they decode to."""
    return bpe.digest(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No stage's decisions can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
