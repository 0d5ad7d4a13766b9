"""Fixed-schema scans of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodemap import schemas
from lodemap.session import spread


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return spread(spark.read.schema(schemas.TURNS).parquet(f"{folder}/conversations.parquet"), "conv_id", "turn")


def read_documents(spark: SparkSession, folder: str, lang: str | None = None, source: str | None = None) -> DataFrame:
    """doc_id, text, lang, source, n_chars; the filters reach the Parquet scan."""
    docs = spark.read.schema(schemas.DOCUMENTS).parquet(f"{folder}/documents.parquet")
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    if source is not None:
        docs = docs.where(F.col("source") == source)
    return spread(docs, "doc_id")


def clean_vectors(raw: DataFrame) -> DataFrame:
    """vec_id, v (doubles), label; null, empty and zero vectors and null entries are dropped."""
    v = F.col("v")
    return (
        raw.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
        .where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))
        .where(F.exists(v, lambda x: x != 0))
    )


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return clean_vectors(spark.read.schema(schemas.EMBEDDINGS).parquet(f"{folder}/embeddings.parquet"))


def _event_time(events: DataFrame) -> DataFrame:
    """`ts` as an instant: a watermark does not take a timestamp without zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return _event_time(spark.read.schema(schemas.EVENTS).parquet(f"{folder}/events.parquet"))


def stream_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events as a stream of the files in a folder, oldest first."""
    reader = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _event_time(reader.parquet(folder))
