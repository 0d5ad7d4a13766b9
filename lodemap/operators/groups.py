"""Groups of concepts: clusters of vectors, their profiles and names, topics."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from lodemap.operators.concepts import top_concepts
from lodemap.scratch import Scratch


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector("v"))


def kmeans(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vec_id, cluster. Parallel k-means on the executors."""
    data = _features(vectors)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("vec_id", "cluster")


def hierarchy(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vec_id, cluster by repeated division of the largest cluster."""
    data = _features(vectors)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("vec_id", "cluster")


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """cluster, size, centroid_norm, medoid, medoid_sim for rows (vec_id, v, cluster).

    Centroids are per-dimension averages, combined on the map side; a cluster of any size
    sends one row per dimension and task. The medoid is a running minimum, not a sort.
    """
    dims = (
        assigned.select("cluster", F.posexplode("v").alias("dim", "x"))
        .groupBy("cluster", "dim").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("size"))
    )
    centroids = dims.groupBy("cluster").agg(
        F.max("size").alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("centroid"),
    )
    centroids = Scratch(assigned.sparkSession, "profile").table(centroids, "centroids")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with("v", "centroid", lambda a, b: a * b), zero, lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, zero, lambda s, x: s + x * x))
    sim = F.round(dot / (norm("v") * norm("centroid")), 6)
    return (
        assigned.join(centroids, "cluster")
        .groupBy("cluster")
        .agg(
            F.first("size").alias("size"),
            F.round(F.first(norm("centroid")), 6).alias("centroid_norm"),
            F.min(F.struct((-sim).alias("neg"), "vec_id")).alias("m"),
        )
        .select("cluster", "size", "centroid_norm", F.col("m.vec_id").alias("medoid"), (-F.col("m.neg")).alias("medoid_sim"))
    )


def cluster_names(ment: DataFrame, group: str, k: int) -> DataFrame:
    """Top-k terms per group by class-based tf-idf: tf in group * ln(1 + A / tf overall),
    where A is the average number of mentions per group."""
    per = ment.groupBy(group, "concept").agg(F.sum("tf").alias("tf"))
    per = Scratch(ment.sparkSession, "names").table(per, "per")  # read three times
    overall = per.groupBy("concept").agg(F.sum("tf").alias("all_tf"))
    average = per.agg(F.sum("tf") / F.count_distinct(group)).scalar()
    scored = per.join(overall, "concept").withColumn(
        "score", F.round(F.col("tf") * F.log(1 + average / F.col("all_tf")), 6)
    )
    return top_concepts(scored, [group], k).select(group, "concept", "tf", "score", "rank")


def agreement(assigned: DataFrame, a: str, b: str) -> DataFrame:
    """One row: purity of `a` against `b` and their Rand index, from the contingency table."""
    cells = assigned.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = Scratch(assigned.sparkSession, "agreement").table(cells, "cells")  # read three times
    rows = cells.groupBy(a).agg(
        F.sum("n").alias("ra"), F.max("n").alias("best"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")
    )
    cols = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    pairs_b = cols.agg(F.sum(F.col("cb") * (F.col("cb") - 1))).scalar()
    sums = rows.agg(
        F.sum("ra").alias("n"), F.sum("best").alias("best"), F.sum("same").alias("same"),
        F.sum(F.col("ra") * (F.col("ra") - 1)).alias("pairs_a"), F.max(pairs_b).alias("pairs_b"),
    )
    n, total = F.col("n"), F.col("n") * (F.col("n") - 1)
    return sums.select(
        "n",
        F.round(F.col("best") / n, 6).alias("purity"),
        F.round((total + 2 * F.col("same") - F.col("pairs_a") - F.col("pairs_b")) / total, 6).alias("rand"),
    )


def topics(units: DataFrame, k: int, seed: int = 1, vocab_size: int = 1 << 18, rounds: int = 10, n_terms: int = 10) -> DataFrame:
    """topic, rank, concept, weight: the heaviest terms of each LDA topic.

    `units` has toks. Every round reads all units. Terms are those in at least 2 units and at
    most half of them; `vocab_size` bounds the model's term matrix, not the choice of terms.
    """
    most = max(1.0, 0.5 * units.count())  # for a share CountVectorizer keeps every token of all units as a JVM string
    counted = CountVectorizer(inputCol="toks", outputCol="features", vocabSize=vocab_size, minDF=2, maxDF=most).fit(units)
    model = LDA(k=k, seed=seed, maxIter=rounds, optimizer="online", subsamplingRate=1.0, featuresCol="features").fit(counted.transform(units))
    terms = units.sparkSession.createDataFrame(list(enumerate(counted.vocabulary)), "term int, concept string")
    return (
        model.describeTopics(n_terms)
        .select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
        .select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.termIndices").alias("term"), F.col("t.termWeights").alias("weight"))
        .join(terms, "term")
        .select("topic", "rank", "concept", "weight")
    )
