"""Graph analysis as rounds of DataFrame jobs.

Every round writes its small result table (see `Scratch`), so lineage stays short and a lost
executor costs one round at most. Node ids are any ordered type. Joins of edges with node
attributes are equi-joins with one attribute row per key: below the broadcast limit Spark
broadcasts the written node table, above it AQE splits the partitions of hub nodes.
Aggregations combine on the map side, so a hub is never gathered in one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from lodemap.operators.relate import both_ways
from lodemap.scratch import Scratch


class NotConverged(RuntimeError):
    """An iterative operator reached its round limit before its fixpoint."""


def degrees(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Degree and strength per node."""
    return (
        both_ways(edges, weight)
        .groupBy(F.col("src").alias("node"))
        .agg(F.count(F.lit(1)).alias("deg"), F.sum(weight).alias("strength"))
    )


def _stars(pairs: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """One star step: connect each node's larger (or smaller) neighbours to its minimum.

    The minima are written first: a join of two scans is one that Spark can split at a hub.
    """
    if large:
        ends = both_ways(pairs)
        low = scratch.table(ends.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), name)
        moved = ends.where(F.col("dst") > F.col("src")).join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        down = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = scratch.table(down.groupBy("src").agg(F.min("dst").alias("m")), name)
        moved = down.join(low, "src").select(F.inline(F.array(
            F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")),
            F.struct(F.col("src").alias("src"), F.col("m").alias("dst")),
        )))
    return moved.where(F.col("src") != F.col("dst")).distinct()


def _only_stars(pairs: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    roles = pairs.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, comp: the smallest node id of the component; isolated nodes keep their own.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of rounds
    grows with the logarithm of the graph, not with its diameter.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = scratch.table(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "r0")
    for i in range(1, max_rounds + 1):
        half = scratch.table(_stars(pairs, True, scratch, f"a{i}"), f"h{i}")
        pairs = scratch.table(_stars(half, False, scratch, f"b{i}"), f"r{i}")
        for old in (f"r{i - 1}", f"a{i}", f"h{i}", f"b{i}"):
            scratch.drop(old)
        if _only_stars(pairs):
            break
    else:
        raise NotConverged(f"components after {max_rounds} rounds")
    return (
        nodes.select("node")
        .join(pairs.select(F.col("src").alias("node"), F.col("dst").alias("root")), "node", "left")
        .select("node", F.coalesce("root", "node").alias("comp"))
    )


def pagerank(nodes: DataFrame, arcs: DataFrame, d: float = 0.85, rounds: int = 10) -> DataFrame:
    """node, rank after fixed rounds over arcs (src, dst); ranks sum to 1.

    The rank of nodes without arcs out is spread evenly; its sum is a scalar subquery on the
    table of the round before, left out when there is no such node.
    """
    scratch = Scratch(nodes.sparkSession, "pagerank")
    arcs = scratch.table(arcs.select("src", "dst"), "arcs")
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    start = scratch.table(nodes.select("node").distinct().join(out, "node", "left"), "nodes")
    n = start.count()
    dangling = not start.where(F.col("out").isNull()).isEmpty()
    ranks = start.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        lost = ranks.where(F.col("out").isNull()).agg(F.sum("rank")).scalar() if dangling else F.lit(0.0)
        got = (
            ranks.where(F.col("out").isNotNull())
            .select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("m"))
            .join(arcs, "src")
            .groupBy(F.col("dst").alias("node")).agg(F.sum("m").alias("m"))
        )
        rank = F.lit((1 - d) / n) + F.lit(d) * (F.coalesce("m", F.lit(0.0)) + lost / F.lit(n))
        ranks = scratch.table(start.join(got, "node", "left").select("node", "out", rank.alias("rank")), f"r{i}")
        if i > 1:
            scratch.drop(f"r{i - 1}")
    return ranks.select("node", "rank")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5, weight: str = "w") -> DataFrame:
    """node, label after synchronous rounds: the heaviest label among the neighbours wins,
    ties to the smallest; nodes without edges keep their own."""
    scratch = Scratch(nodes.sparkSession, "labels")
    ends = scratch.table(both_ways(edges, weight), "ends")
    labels = scratch.table(nodes.select("node", F.col("node").alias("label")).distinct(), "r0")
    for i in range(1, rounds + 1):
        best = (
            ends.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy("src", "label").agg(F.sum(weight).alias("s"))
            .groupBy(F.col("src").alias("node"))
            .agg(F.min(F.struct((-F.col("s")).alias("neg"), F.col("label")))["label"].alias("best"))
        )
        labels = scratch.table(
            labels.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label")), f"r{i}"
        )
        scratch.drop(f"r{i - 1}")
    return labels


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, deg, triangles and local clustering coefficient.

    Edges point from the end of lower degree, so no out-list is longer than sqrt(2 * edges).
    Triangles are the common entries of two out-lists; open wedges never become rows.
    """
    scratch = Scratch(edges.sparkSession, "triangles")
    edges = scratch.table(edges.select("src", "dst"), "edges")
    deg = scratch.table(both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg")), "deg")
    a = deg.select(F.col("node").alias("src"), F.col("deg").alias("da"))
    b = deg.select(F.col("node").alias("dst"), F.col("deg").alias("db"))
    first = F.struct("da", "src") < F.struct("db", "dst")
    arcs = scratch.table(
        edges.select("src", "dst").join(a, "src").join(b, "dst").select(
            F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"),
            F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"),
        ),
        "arcs",
    )
    outs = scratch.table(arcs.groupBy("u").agg(F.collect_list("v").alias("out")), "outs")
    found = (
        arcs.join(outs, "u")
        .join(outs.select(F.col("u").alias("v"), F.col("out").alias("out_v")), "v")
        .select("u", "v", F.explode(F.array_intersect("out", "out_v")).alias("x"))
        .select(F.explode(F.array("u", "v", "x")).alias("node"))
        .groupBy("node").agg(F.count(F.lit(1)).alias("tri"))
    )
    tri, dg = F.coalesce("tri", F.lit(0)), F.coalesce("deg", F.lit(0))
    return (
        nodes.select("node").join(deg, "node", "left").join(found, "node", "left")
        .select(
            "node", dg.alias("deg"), tri.alias("triangles"),
            F.when(dg > 1, F.round(2.0 * tri / (dg * (dg - 1)), 6)).otherwise(F.lit(0.0)).alias("clustering"),
        )
    )


def paths(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """node, hop, pred: smallest hop count from the seeds and its smallest predecessor.

    Each round writes only its frontier; visited nodes are the frontiers so far.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    ends = scratch.table(both_ways(edges), "ends")
    kind = ends.schema["src"].dataType
    front = scratch.table(
        seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast(kind).alias("pred")), "hop0"
    )
    visited = front
    for hop in range(1, max_hops + 1):
        step = (
            ends.join(front.select(F.col("node").alias("src")), "src")
            .groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
            .join(visited.select("node"), "node", "left_anti")
            .select("node", F.lit(hop).alias("hop"), "pred")
        )
        front = scratch.table(step, f"hop{hop}")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Nodes within k hops of the seeds, with the smallest hop."""
    return paths(edges, seeds, k).select("node", "hop")


def modularity(edges: DataFrame, labels: DataFrame, weight: str = "w") -> DataFrame:
    """One row: modularity of a partition (node, label), with its inside and total weight."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    w = F.col(weight)
    inside = F.when(F.col("la") == F.col("lb"), w).otherwise(F.lit(0) * w)
    ends = F.array(
        F.struct(F.col("la").alias("label"), w.alias("d"), inside.alias("i")),
        F.struct(F.col("lb").alias("label"), w.alias("d"), (F.lit(0) * w).alias("i")),
    )
    per = (
        edges.join(a, "src").join(b, "dst").select(F.inline(ends))
        .groupBy("label").agg(F.sum("d").alias("d"), F.sum("i").alias("i"))
    )
    # sum over labels of i/m - (d/2m)^2, with m = half the sum of d
    sums = per.agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("i").alias("i"), F.sum("d").alias("d"),
        F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"),
    )
    i, d, dd = (F.col(c).cast("double") for c in ("i", "d", "dd"))
    return sums.select("n_labels", F.round(2 * i / d - dd / (d * d), 6).alias("q"))


def quotient(edges: DataFrame, labels: DataFrame, weight: str = "w") -> DataFrame:
    """Communities as super-nodes: summed edges (src, dst labels, src <= dst), n and w."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    return (
        edges.join(a, "src").join(b, "dst")
        .groupBy(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias(weight))
    )


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core: nodes of degree below k are dropped until none is left.

    A round peels one layer and writes what stays; there are as many as the graph has layers.
    """
    scratch = Scratch(edges.sparkSession, "core")
    kept = scratch.table(edges, "r0")
    size = kept.count()
    for i in count(1):
        strong = both_ways(kept).groupBy("src").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") >= k).select("src")
        strong = scratch.table(strong, f"s{i}")
        after = scratch.table(
            kept.join(strong, "src", "left_semi").join(strong.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*kept.columns),
            f"r{i}",
        )
        n = after.count()
        scratch.drop(f"r{i - 1}")
        scratch.drop(f"s{i}")
        kept = after
        if n == size:
            return kept
        size = n


def _jump(pointers: DataFrame) -> DataFrame:
    """Follow each pointer comp -> root one step further; `moved` tells whether that changed it."""
    on = pointers.select(F.col("comp").alias("root"), F.col("root").alias("next"))
    return pointers.join(on, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))


def _roots(scratch: Scratch, pointers: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """comp, root for pointers comp -> to whose only cycles are mutual pairs."""
    on = pointers.select(F.col("comp").alias("to"), F.col("to").alias("next"))
    root = F.when(F.col("next") == F.col("comp"), F.least("comp", "to")).otherwise(F.col("to"))
    jumps = scratch.table(pointers.join(on, "to").select("comp", root.alias("root")), f"{name}-j0")
    for i in range(1, max_rounds + 1):
        # Two jumps per written round; a pointer that the second one still moves is not done.
        far = _jump(_jump(jumps).drop("moved"))
        jumps = scratch.table(far, f"{name}-j{i}")
        if jumps.where("moved").isEmpty():
            return jumps.select("comp", "root")
        jumps = jumps.select("comp", "root")
    raise NotConverged(f"pointer jumping after {max_rounds} rounds")


def spanning_forest(nodes: DataFrame, edges: DataFrame, weight: str = "w", max_rounds: int = 40) -> DataFrame:
    """Maximum-weight spanning forest by Boruvka rounds; ties by (src, dst).

    Each round every component takes its best edge out. The order of edges is total, so the
    takes form trees with one mutual pair each; pointer jumping finds the roots. The number
    of components with an edge out at least halves per round.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    comp = scratch.table(nodes.select("node", F.col("node").alias("comp")).distinct(), "c0")
    left = scratch.table(edges.select("src", "dst", weight), "e0")
    forest = None
    for i in range(1, max_rounds + 1):
        ca = comp.select(F.col("node").alias("src"), F.col("comp").alias("ca"))
        cb = comp.select(F.col("node").alias("dst"), F.col("comp").alias("cb"))
        # Edges inside a component can never be chosen again, so later rounds read fewer.
        left = scratch.table(
            left.select("src", "dst", weight).join(ca, "src").join(cb, "dst").where(F.col("ca") != F.col("cb")), f"e{i}"
        )
        edge = F.struct((-F.col(weight)).alias("neg"), "src", "dst", weight)
        offers = F.array(
            F.struct(F.col("ca").alias("comp"), F.col("cb").alias("to"), edge.alias("e")),
            F.struct(F.col("cb").alias("comp"), F.col("ca").alias("to"), edge.alias("e")),
        )
        taken = scratch.table(
            left.select(F.inline(offers)).groupBy("comp").agg(F.min(F.struct("e", "to")).alias("p"))
            .select("comp", F.col("p.to").alias("to"), "p.e.src", "p.e.dst", f"p.e.{weight}"),
            f"t{i}",
        )
        if taken.isEmpty():
            break
        chosen = taken.select("src", "dst", weight).distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        roots = _roots(scratch, taken.select("comp", "to"), f"t{i}", max_rounds)
        comp = scratch.table(
            comp.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"c{i}"
        )
        scratch.drop(f"c{i - 1}")
        scratch.drop(f"e{i - 1}")
    else:
        raise NotConverged(f"spanning_forest after {max_rounds} rounds")
    return forest if forest is not None else edges.select("src", "dst", weight).limit(0)
