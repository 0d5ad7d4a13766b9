"""Coordinates and zoom tables for a viewer elsewhere. Tables only, no drawing."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodemap.scratch import Scratch


def project_pca(vectors: DataFrame) -> DataFrame:
    """vec_id, x, y on the first two principal axes; each axis has its largest loading positive."""
    data = vectors.withColumn("features", array_to_vector("v"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(data)
    loads = model.pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loads.T]
    xy = vector_to_array("xy")
    return model.transform(data).select(
        "vec_id", (xy[0] * signs[0]).alias("x"), (xy[1] * signs[1]).alias("y")
    )


def _start(node: str, seed: int, axis: int) -> Column:
    """A fixed place in [0, 1) from the node id: 32 bits of a digest."""
    digest = F.md5(F.concat_ws("/", F.col(node).cast("string"), F.lit(str(seed)), F.lit(str(axis))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def layout_force(nodes: DataFrame, edges: DataFrame, rounds: int = 10, seed: int = 1, grid: int = 8, weight: str = "w") -> DataFrame:
    """node, x, y in the unit square after fixed rounds of pull along edges and push from
    grid cells.

    A round costs two joins of edges with positions. The push comes from the centres of at
    most grid * grid cells, held in one array of that bound.
    """
    scratch = Scratch(nodes.sparkSession, "layout")
    links = scratch.table(edges.select("src", "dst", F.col(weight).cast("double").alias("w")), "links")
    top = links.agg(F.max("w")).first()[0] or 1.0
    pos = scratch.table(
        nodes.select("node").distinct().select("node", _start("node", seed, 0).alias("x"), _start("node", seed, 1).alias("y")), "p0"
    )
    n = max(pos.count(), 1)
    ideal = n ** -0.5
    for i in range(1, rounds + 1):
        step = 0.1 * (1 - (i - 1) / rounds)
        cells = (
            pos.groupBy(F.floor(F.col("x") * grid).alias("cx"), F.floor(F.col("y") * grid).alias("cy"))
            .agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
            .agg(F.array_sort(F.collect_list(F.struct("cx", "cy", "n", "x", "y"))))
            .scalar()
        )
        a = pos.select(F.col("node").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = pos.select(F.col("node").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
        size = F.sqrt(dx * dx + dy * dy) * F.col("w") / top / ideal
        pull = (
            links.join(a, "src").join(b, "dst")
            .select(F.inline(F.array(
                F.struct(F.col("src").alias("node"), (dx * size).alias("fx"), (dy * size).alias("fy")),
                F.struct(F.col("dst").alias("node"), (-dx * size).alias("fx"), (-dy * size).alias("fy")),
            )))
            .groupBy("node").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        )

        def push(axis: str) -> Column:
            def term(c):
                ex, ey = F.col("x") - c["x"], F.col("y") - c["y"]
                return c["n"] * (F.col(axis) - c[axis]) * ideal * ideal / (ex * ex + ey * ey + ideal * ideal)
            return F.aggregate(F.transform("cells", term), F.lit(0.0), lambda s, v: s + v)

        moved = (
            pos.join(pull, "node", "left").withColumn("cells", cells)
            .select(
                "node", "x", "y",
                (F.coalesce("fx", F.lit(0.0)) + push("x")).alias("fx"),
                (F.coalesce("fy", F.lit(0.0)) + push("y")).alias("fy"),
            )
        )
        length = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        move = F.when(length > 0, F.least(length, F.lit(step)) / length).otherwise(F.lit(0.0))

        def inside(axis: str, force: str) -> Column:
            return F.greatest(F.lit(0.0), F.least(F.lit(0.999999), F.col(axis) + F.col(force) * move))

        pos = scratch.table(
            moved.select("node", F.round(inside("x", "fx"), 9).alias("x"), F.round(inside("y", "fy"), 9).alias("y")), f"p{i}"
        )
        scratch.drop(f"p{i - 1}")
    return pos


def _cell(axis: str, zoom: Column, low: float, high: float) -> Column:
    """Cell number of a coordinate at a zoom level: 2^zoom cells over [low, high].

    Coordinates outside have cells of their own, below 0 or from 2^zoom on: nothing is counted
    in a border cell that is not in it.
    """
    cells = F.pow(F.lit(2.0), zoom)
    at = F.floor((F.col(axis) - low) / (high - low) * cells)
    return F.when(F.col(axis) == high, cells - 1).otherwise(at).cast("int")


def tiles(nodes: DataFrame, z_max: int, k: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """z, tx, ty, n, top for zooms 0..z_max over nodes (node, x, y, score).

    `top` holds the k best nodes of the cell by score, then id. Only the finest zoom reads the
    nodes: a coarser cell is four finer ones, its count their sum and its best k among their
    best k. What is repeated per zoom is cells with k nodes each, not nodes. Both steps keep
    k rows per cell in each task before the shuffle, zoom 0 with its one cell included.
    """
    fine = nodes.select(
        _cell("x", F.lit(z_max), low, high).alias("fx"), _cell("y", F.lit(z_max), low, high).alias("fy"), "node", "score"
    )
    scratch = Scratch(nodes.sparkSession, "tiles")
    in_fine = Window.partitionBy("fx", "fy").orderBy(F.desc("score"), "node")
    counts = scratch.table(fine.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n")), "counts")
    best = scratch.table(fine.withColumn("r", F.row_number().over(in_fine)).where(F.col("r") <= k).drop("r"), "best")

    def zoomed(df: DataFrame) -> DataFrame:
        out = df.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(z_max))))
        ratio = F.pow(F.lit(2.0), F.lit(z_max) - F.col("z"))
        return out.withColumn("tx", F.floor(F.col("fx") / ratio).cast("int")).withColumn("ty", F.floor(F.col("fy") / ratio).cast("int"))

    cell = ["z", "tx", "ty"]
    w = Window.partitionBy(*cell).orderBy(F.desc("score"), "node")
    tops = (
        zoomed(best).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("top"))
    )
    return zoomed(counts).groupBy(*cell).agg(F.sum("n").alias("n")).join(tops, cell)


def viewport(nodes: DataFrame, box: tuple[float, float, float, float], k: int) -> DataFrame:
    """The k best nodes inside x0, y0, x1, y1: a pushed range filter and a top-k."""
    x0, y0, x1, y1 = box
    return (
        nodes.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        .orderBy(F.desc("score"), "node").limit(k)
    )


def bundle_edges(nodes: DataFrame, edges: DataFrame, z: int, weight: str = "w", low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Edges summed per unordered pair of cells at one zoom: ax, ay, bx, by, n, w."""
    at = F.lit(z)
    cell = nodes.select("node", F.struct(_cell("x", at, low, high).alias("tx"), _cell("y", at, low, high).alias("ty")).alias("c"))
    a = cell.select(F.col("node").alias("src"), F.col("c").alias("ca"))
    b = cell.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
    return (
        edges.join(a, "src").join(b, "dst")
        .groupBy(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias(weight))
        .select(
            F.col("p.tx").alias("ax"), F.col("p.ty").alias("ay"), F.col("q.tx").alias("bx"), F.col("q.ty").alias("by"), "n", weight
        )
    )
