"""Writing maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodemap.scratch import Scratch


def write_map(nodes: DataFrame, edges: DataFrame, path: str, map_id: str) -> None:
    """Write one map below `path`/nodes and `path`/edges, replacing that map_id only.

    A table without rows leaves none of the map's earlier ones: its partition is deleted.
    """
    spark = nodes.sparkSession
    for name, table in (("nodes", nodes), ("edges", edges)):
        if table.isEmpty():
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/map_id={map_id}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        (
            table.withColumn("map_id", F.lit(map_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("map_id").parquet(f"{path}/{name}")
        )


def top_map(nodes: DataFrame, edges: DataFrame, n: int, by: str = "score") -> tuple[DataFrame, DataFrame]:
    """The n best nodes (ties by id) and the edges between them. The n nodes are written once."""
    best = Scratch(nodes.sparkSession, "top").table(nodes.orderBy(F.desc(by), "node").limit(n), "nodes")
    ids = best.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )
    return best, inside.select(*edges.columns)


def export_top(nodes: DataFrame, edges: DataFrame, n: int, path: str, by: str = "score") -> None:
    """`top_map` as JSON lines for an outside viewer."""
    best, inside = top_map(nodes, edges, n, by)
    best.write.mode("overwrite").json(f"{path}/nodes")
    inside.write.mode("overwrite").json(f"{path}/edges")
