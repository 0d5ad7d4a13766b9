"""A training corpus in five stages: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the documents of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodemap.llm import bpe, jaccard_join, langid, mixing, toxicity
from lodemap.scratch import Scratch

#: Text of a block of the encoder: workers that have served four stages before hold less at once.
BPE_BLOCK_BYTES = 6 << 20

#: Learned models and component searches are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without text or letters go."""
    return langid.known_language(docs, langid.split_fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.not_toxic(docs, toxicity.split_fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and 0.8: the smallest doc_id."""
    return jaccard_join.one_of_each(docs, jaccard_join.join(docs, words=5, least=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, "ids", block_bytes=BPE_BLOCK_BYTES)


STAGES = [("language ID", language_id), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
