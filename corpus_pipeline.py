"""From raw documents to packed training sequences, stage by stage.

Each stage works on everything that the one before has kept; its result is written as Parquet to the shared folder and read
again as the next one's documents. A lost executor repeats tasks of one stage, a lost driver the stages whose result is not
there yet.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from markspan.llm import digest_index, minhash, packing, perplexity, pii
from markspan.session import set_local_folder, written

NEAR = minhash.Settings(width=5, num=80)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage may be run by itself: in a single process without a shared folder it gets one."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_local_folder(spark, tempfile.mkdtemp)
        return work(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold; models are counted over the trusted ones of `docs`."""
    return perplexity.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that with the smallest id."""
    return digest_index.without_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs, NEAR)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with masks in place of personal data."""
    return pii.mask_pii(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document in sequences of at most 2048 ids."""
    return packing.pack(docs, Path(TOKENIZER).read_text())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", pack),
]

# The first stage needs a language model, so SQL cannot give the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_local_folder(spark, tempfile.mkdtemp)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = written(work(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
