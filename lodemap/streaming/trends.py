"""Concept trends over an event stream. Each function maps a stream to a stream; the event
type is the concept unless another column is named. State is one row per open window (or id),
bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(events: DataFrame, window: Column, late: str, concept: str) -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), F.col(concept).alias("concept"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "concept", "n", "value")
    )


def trend_tumbling(events: DataFrame, size: str, late: str, concept: str = "event_type") -> DataFrame:
    """Count per concept and window; in append mode only closed windows come out."""
    return _counted(events, F.window("ts", size), late, concept)


def trend_sliding(events: DataFrame, size: str, slide: str, late: str, concept: str = "event_type") -> DataFrame:
    """As `trend_tumbling` over overlapping windows."""
    return _counted(events, F.window("ts", size, slide), late, concept)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions per user: start, end (last event plus gap), events and kinds of concepts.

    Sessions are merged inside each input task before the shuffle, for users with very many
    events.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    total = F.size(F.collect_set("event_type"))  # a set of types, not of events
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), total.alias("concepts"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "concepts")
    )


def dedup_stream(events: DataFrame, late: str) -> DataFrame:
    """One row per event_id among events that arrive within `late` of each other.

    Duplicates go first per id and input task, then per id, so an id that makes up much of
    the stream reaches its one state row as at most one row per input task.
    """
    return (
        events.withColumn("task", F.spark_partition_id())
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["event_id", "task"])
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("task")
    )


def tag_stream(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add the concept of the number in `props`, from a static dictionary (k, concept).

    Events without an entry keep a null concept.
    """
    k = F.from_json("props", "map<string,string>")["k"].cast("bigint")
    return events.withColumn("k", k).join(dictionary, "k", "left")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all data now present, into Parquet files, and wait for it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
