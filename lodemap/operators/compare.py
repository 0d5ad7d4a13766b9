"""Comparing maps between groups or over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodemap.operators.relate import both_ways
from lodemap.scratch import Scratch


def map_diff(edges_a: DataFrame, edges_b: DataFrame, weight: str = "n") -> DataFrame:
    """src, dst, status (added, removed, changed, same) and delta from a to b."""
    a = edges_a.select("src", "dst", F.col(weight).alias("wa"))
    b = edges_b.select("src", "dst", F.col(weight).alias("wb"))
    status = (
        F.when(F.col("wa").isNull(), "added").when(F.col("wb").isNull(), "removed")
        .when(F.col("wa") == F.col("wb"), "same").otherwise("changed")
    )
    return a.join(b, ["src", "dst"], "full").select(
        "src", "dst", status.alias("status"),
        (F.coalesce("wb", F.lit(0)) - F.coalesce("wa", F.lit(0))).alias("delta"),
    )


def rank_groups(stats: DataFrame, group: str) -> DataFrame:
    """Add `rank`: dense rank by df inside each group.

    The rank of a concept is one more than the number of distinct larger df values, so only
    the distinct (group, df) values are ranked, not the concepts of a group in one task.
    The ranks are written: most concepts have a df of 1 or 2, and a written table of known
    size lets Spark broadcast it rather than shuffle the concepts on those few values.
    """
    values = stats.select(group, "df").distinct()
    w = Window.partitionBy(group).orderBy(F.desc("df"))
    ranks = Scratch(stats.sparkSession, "ranks").table(values.withColumn("rank", F.dense_rank().over(w)), "ranks")
    return stats.join(ranks, [group, "df"])


def rank_shift(stats: DataFrame, group: str) -> DataFrame:
    """Per group and concept: rank by df in the group, rank over all groups, and the shift.

    Every group is compared with the whole, so the result grows with the input and not with
    the number of pairs of groups.
    """
    whole = stats.groupBy("concept").agg(F.sum("df").alias("df"))
    overall = rank_groups(whole.withColumn("g", F.lit(0)), "g").select("concept", F.col("rank").alias("rank_all"))
    return (
        rank_groups(stats, group).join(overall, "concept")
        .select(group, "concept", "rank", "rank_all", (F.col("rank_all") - F.col("rank")).alias("shift"))
    )


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concepts in both."""
    return a.select("concept").intersect(b.select("concept"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concepts of a that are not in b."""
    return a.select("concept").distinct().exceptAll(b.select("concept").distinct())


def neighbour_overlap(edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """concept, n_both, n_either, jaccard of its neighbour sets in two maps.

    Neighbour entries are marked by map and counted; a hub's neighbours are never gathered
    in one row.
    """
    marks = both_ways(edges_a).withColumn("m", F.lit(1)).unionByName(both_ways(edges_b).withColumn("m", F.lit(2)))
    per = marks.groupBy("src", "dst").agg(F.bit_or("m").alias("m"))
    return (
        per.groupBy(F.col("src").alias("concept"))
        .agg(F.sum((F.col("m") == 3).cast("int")).alias("n_both"), F.count(F.lit(1)).alias("n_either"))
        .withColumn("jaccard", F.round(F.col("n_both") / F.col("n_either"), 6))
    )


def drift(stats: DataFrame, key: str, bucket: str) -> DataFrame:
    """Per key and bucket: n, change to the previous bucket, mean of the last three.

    `stats` has one row per key and bucket (key, bucket, n): counts are made before, so a
    window holds the buckets of one key only.
    """
    w = Window.partitionBy(key).orderBy(bucket)
    return stats.select(
        key, bucket, "n",
        (F.col("n") - F.lag("n").over(w)).alias("change"),
        F.round(F.avg("n").over(w.rowsBetween(-2, 0)), 6).alias("mean3"),
    )
