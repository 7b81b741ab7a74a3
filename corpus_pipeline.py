"""A corpus from raw documents to packed sequences: each stage's rows are written and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm.common import drop, materialize, read, tables
from portolan.llm.language_id import keep_identified
from portolan.llm.mixing import mixed_documents
from portolan.llm.near_dedup import keep_one
from portolan.llm.packing import pack
from portolan.llm.personal_data import sanitised


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return keep_one(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced; n_chars counts what is left."""
    return sanitised(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of up to 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Tokenizers, fitted models and hashes are no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with tables(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            drop(before)  # the rows of the stage before, which are no longer read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
