"""Session helpers: a local session for tests and the bench, and input spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodemap")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


FEW_SPLITS = 64


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread `df` by unique keys, only when the scan has few splits for the cores.

    A table of one or two files reads as one or two tasks, which starves the CPU-heavy
    tokenising that follows. A table of over FEW_SPLITS splits is returned untouched, so no
    large text is ever shuffled for balance.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, FEW_SPLITS):
        return df
    return df.repartition(cores, *keys)
