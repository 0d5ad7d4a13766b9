"""Approximate neighbours by cells of a two-level k-means index.

Every vector lies in one leaf cell of about LEAF vectors. The upper level has about the square root of as
many centroids as there are leaves, fitted on a bounded sample; inside an upper cell, leaves are seeded by
a hash draw of its own vectors and moved to the means of what they attract. As a query, a vector goes to
the leaves whose centroids are nearest, found through its nearest upper cells, and is compared exactly with
what lies there. The number of leaves it visits is fixed, so products per vector hardly grow with the table.

Centroids follow the density of the data: a crowd of near copies gets as many cells as its share. Cells
are handled in blocks of bounded size anyway.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodemap.scratch import Scratch

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a leaf, on average; leaves that a query visits; upper cells that it looks for them in.
LEAF, PROBES, UPPER_PROBES = 64, 20, 8
#: Upper centroids at most, and vectors of the sample for each of them: what reaches the driver.
MOST_UPPER, SAMPLE = 2048, 48
#: Rows of a block.
BLOCK = 4096


def _units(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """`n` spherical k-means centroids of unit rows; a cell that empties keeps its centroid."""
    rng = np.random.default_rng(seed)
    at = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        near = np.concatenate([(sample[s : s + 4096] @ at.T).argmax(1) for s in range(0, len(sample), 4096)])
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(size > 0, total / np.maximum(size, 1e-12), at)
    return at


def _nearest(vectors: DataFrame, upper: np.ndarray, k: int) -> DataFrame:
    """`vectors` (vec_id, v) with `top`, an array of its k nearest upper cells."""
    sent = vectors.sparkSession.sparkContext.broadcast(upper)  # MOST_UPPER rows at most

    def run(frames):
        for pdf in frames:
            sim = _units(pdf["v"]) @ sent.value.T
            most = min(k, sim.shape[1])
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most] if most < sim.shape[1] else np.tile(np.arange(most), (len(sim), 1))
            order = np.take_along_axis(-sim, best, 1).argsort(1, kind="stable")
            yield pdf.assign(top=list(np.take_along_axis(best, order, 1).astype(np.int32)))

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id long, v array<double>, top array<int>")


def _met(rows: DataFrame, leaves: DataFrame, scratch: Scratch, name: str, k: int) -> DataFrame:
    """vec_id, leaf, sim: the k nearest leaves of rows (top, vec_id, v) among leaves (top, leaf, c) of the same upper cell."""
    sizes = rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = scratch.table(sizes, f"{name}-sizes")
    dealt = rows.join(sizes, "top").select(
        "top", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_leaf"), F.col("vec_id").alias("id"), "v")
    sent = leaves.join(sizes, "top").select(
        "top", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_leaf"), F.col("leaf").alias("id"), F.col("c").alias("v"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, own = pdf[pdf["is_leaf"]], pdf[~pdf["is_leaf"]]
        if not len(cells) or not len(own):
            return pd.DataFrame({"vec_id": np.empty(0, np.int64), "leaf": np.empty(0, np.int64), "sim": np.empty(0)})
        cells = cells.sort_values("id")
        sim = _units(own["v"]) @ _units(cells["v"]).T
        most = min(k, sim.shape[1])
        best = np.argsort(-sim, axis=1, kind="stable")[:, :most]
        return pd.DataFrame({"vec_id": np.repeat(own["id"].to_numpy(), most), "leaf": cells["id"].to_numpy()[best.ravel()], "sim": np.take_along_axis(sim, best, 1).ravel()})

    return dealt.unionByName(sent).groupBy("top", "block").applyInPandas(group, "vec_id long, leaf long, sim double")


class Index:
    """Leaves of a table of different vectors (vec_id, v), and who lies where."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, leaf: int = LEAF, seed: int = 7):
        self.scratch = scratch
        n = vectors.count()
        wanted = max(1, math.ceil(n / leaf))
        upper = min(MOST_UPPER, max(1, math.ceil(math.sqrt(wanted))))
        draw = lambda label, of: F.pmod(F.xxhash64(F.lit(f"{label}{seed}"), "vec_id"), F.lit(1 << 30)) < int(of * (1 << 30))
        share = min(1.0, 1.2 * upper * SAMPLE / max(n, 1))
        sample = vectors.where(draw("sample", share)).select("v").limit(2 * upper * SAMPLE).toPandas()
        self.upper = centroids(_units(sample["v"]), upper) if len(sample) else np.zeros((0, 1))
        if not len(sample):
            self.placed = None
            return
        self.placed = scratch.table(_nearest(vectors, self.upper, UPPER_PROBES), "placed")
        home = self.placed.select(F.col("top")[0].alias("top"), "vec_id", "v")
        # leaves by a draw, and one of each upper cell in any case
        first = home.groupBy("top").agg(F.min(F.struct(F.xxhash64("vec_id").alias("h"), "vec_id"))["vec_id"].alias("vec_id"))
        drawn = home.where(draw("leaf", 1 / leaf)).select("top", "vec_id").unionByName(first).distinct()
        seeds = scratch.table(home.join(drawn, ["top", "vec_id"]).select("top", F.col("vec_id").alias("leaf"), F.col("v").alias("c")), "seeds")
        near = scratch.table(_met(home, seeds, scratch, "seeds", 1), "attracted")
        unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))
        means = near.join(home, "vec_id").select("top", "leaf", F.posexplode(unit).alias("i", "x")).groupBy("top", "leaf", "i").agg(F.avg("x").alias("x"))
        means = means.groupBy("top", "leaf").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("top", "leaf", F.col("c.x").alias("c"))
        self.leaves = scratch.table(means.where(F.exists("c", lambda x: x != 0)), "leaves")
        self.members = scratch.table(_met(home, self.leaves, scratch, "leaves", 1).select("vec_id", "leaf"), "members")

    def visits(self, probes: int) -> DataFrame:
        """vec_id, leaf: the leaves that each vector visits as a query, its own included."""
        asked = self.placed.select(F.explode("top").alias("top"), "vec_id", "v")
        near = _met(asked, self.leaves, self.scratch, "visits", probes)
        by = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "leaf")
        best = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= probes).select("vec_id", "leaf")
        return self.scratch.table(best.unionByName(self.members).distinct(), "visited")

    def needed(self, pairs: DataFrame, share: float) -> int | None:
        """The smallest number of probes by which `share` of the pairs (src, dst) meet, src as the query; None if no number does.

        For a bounded sample of pairs: their positions reach the driver.
        """
        pairs = self.scratch.table(pairs.select("src", "dst"), "wanted")
        asked = self.placed.join(pairs.select(F.col("src").alias("vec_id")).distinct(), "vec_id", "left_semi")
        asked = asked.select(F.explode("top").alias("top"), "vec_id", "v")
        by = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "leaf")
        near = _met(asked, self.leaves, self.scratch, "needed", np.iinfo(np.int32).max).withColumn("r", F.row_number().over(by))
        home = pairs.join(self.members.select(F.col("vec_id").alias("dst"), "leaf"), "dst")
        home = home.join(self.members.select(F.col("vec_id").alias("src"), F.col("leaf").alias("own")), "src")
        at = home.join(near.select(F.col("vec_id").alias("src"), "leaf", "r"), ["src", "leaf"], "left")
        at = at.select(F.when(F.col("own") == F.col("leaf"), 0).otherwise(F.col("r")).alias("r")).toPandas()["r"]
        at = np.sort(at.fillna(np.inf).to_numpy(np.float64))
        worst = at[math.ceil(share * len(at)) - 1] if len(at) else 0
        return int(worst) if np.isfinite(worst) else None

    def compared(self, probes: int, keep, schema: str) -> DataFrame:
        """What `keep(queries, members)` returns for the blocks of every leaf; both have vec_id and v."""
        visits = self.visits(probes)
        sizes = self.scratch.table(visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows")).join(
            self.members.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cols")), "leaf"), "leaf-sizes")
        vectors = self.placed.select("vec_id", "v")
        mine = lambda blocks: F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
        asks = visits.join(sizes, "leaf").select(
            "leaf", mine("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("asks"), "vec_id")
        there = self.members.join(sizes, "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), mine("cols").alias("j"), F.lit(False).alias("asks"), "vec_id")
        both = asks.unionByName(there).join(vectors, "vec_id")

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            return keep(pdf[pdf["asks"]], pdf[~pdf["asks"]])

        return both.groupBy("leaf", "i", "j").applyInPandas(group, schema)

    def products(self, probes: int) -> int:
        """Products of two vectors that the index and its search have taken, symmetric ones counted twice."""
        visits, leaves = self.visits(probes), self.leaves.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        members = self.members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        routed = self.placed.select(F.explode("top").alias("top")).join(leaves, "top").agg(F.sum("n")).first()[0] or 0
        home = self.placed.select(F.col("top")[0].alias("top")).join(leaves, "top").agg(F.sum("n")).first()[0] or 0
        final = visits.join(members, "leaf").agg(F.sum("n")).first()[0] or 0
        return self.placed.count() * len(self.upper) + 2 * home + routed + final
