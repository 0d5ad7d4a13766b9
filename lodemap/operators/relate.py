"""Edges between concepts: co-occurrence, association, cue and response, pruning.

Undirected edges have `src` < `dst`; directed ones are `cue`, `resp`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodemap.functions import scores, text as tx
from lodemap.operators.concepts import concept_sets, token_units
from lodemap.operators.pairs import pair_counts
from lodemap.scratch import Scratch


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """Each undirected edge once from either end, in one pass over the edges."""
    out = F.struct("src", "dst", *cols)
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return edges.select(F.inline(F.array(out, back)))


def _named(counts: DataFrame, vocab: DataFrame, left: str, right: str) -> DataFrame:
    """Replace ids a, b by concept labels; the vocabulary side is small and written."""
    one = vocab.select(F.col("cid").alias("a"), F.col("concept").alias(left))
    two = vocab.select(F.col("cid").alias("b"), F.col("concept").alias(right))
    return counts.join(one, "a").join(two, "b").drop("a", "b")


def _checked(vocab: DataFrame, width: int) -> DataFrame:
    """The vocabulary, if its ids are below `width`; one number is read from the written table."""
    most = vocab.agg(F.max("cid")).first()[0]
    if most is not None and most >= width:
        raise ValueError(f"width {width} is too small for a vocabulary with ids up to {most}")
    return vocab


def cooccur_bag(units: DataFrame, vocab: DataFrame, width: int) -> DataFrame:
    """Edges src, dst, n: in how many units both concepts occur. No unit is too large.

    `width` is the size of the vocabulary (its ids are 0..width-1).
    """
    rows = concept_sets(units, _checked(vocab, width)).select(F.col("ids").alias("l"), F.col("ids").alias("r"))
    named = _named(pair_counts(rows, width, upper=True).drop("grp"), vocab, "x", "y")
    return named.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "n")


def cooccur_window(units: DataFrame, vocab: DataFrame, w: int, by: Sequence[str] = ()) -> DataFrame:
    """Edges src, dst, n: position pairs at distance 1..w, equal tokens excluded.

    Each token is lined up with the next w tokens inside the row. A row whose own token is
    not in the vocabulary goes before the w-fold expansion.
    """
    shifted = [tx.ahead("toks", k).alias(f"t{k}") for k in range(w + 1)]
    known = vocab.select(F.col("concept").alias("x"))
    return (
        units.select(*by, F.inline_outer(F.arrays_zip(*shifted)))
        .withColumnRenamed("t0", "x")
        .join(known, "x")
        .select(*by, "x", F.explode(F.array(*[f"t{k}" for k in range(1, w + 1)])).alias("y"))
        .where(F.col("y").isNotNull() & (F.col("x") != F.col("y")))
        .join(known.withColumnRenamed("x", "y"), "y")
        .groupBy(*by, F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assoc(edges: DataFrame, stats: DataFrame, n_units: Column | int) -> DataFrame:
    """Association scores of edges (src, dst, n) from unit counts (concept, df)."""
    total = n_units if isinstance(n_units, Column) else F.lit(n_units)
    na = stats.select(F.col("concept").alias("src"), F.col("df").alias("na"))
    nb = stats.select(F.col("concept").alias("dst"), F.col("df").alias("nb"))
    n, a, b = F.col("n"), F.col("na"), F.col("nb")
    return (
        edges.join(na, "src").join(nb, "dst")
        .select(
            "src", "dst", "n", "na", "nb",
            F.round(scores.pmi(n, a, b, total), 6).alias("pmi"),
            F.round(scores.npmi(n, a, b, total), 6).alias("npmi"),
            F.round(scores.lift(n, a, b, total), 6).alias("lift"),
            F.round(scores.jaccard(n, a, b), 6).alias("jaccard"),
            F.round(scores.dice(n, a, b), 6).alias("dice"),
            F.round(scores.g2(n, a, b, total), 6).alias("g2"),
        )
    )


def _turn_sets(turns: DataFrame, vocab: DataFrame, marker: int | None = None) -> DataFrame:
    return concept_sets(token_units(turns, "conv_id", "turn", "role"), vocab, marker)


def cue_response(turns: DataFrame, vocab: DataFrame, width: int, min_n: int = 1) -> DataFrame:
    """Arcs cue -> resp over user turns and the assistant turn that follows at once.

    n: turn pairs whose user turn has the cue and whose reply has the response; conf =
    n / n(cue); lift = n * P / (n(cue) * n(resp)) over P turn pairs. Turn pairs meet by an
    equi-join on (conv_id, turn), so a very long conversation spreads over all tasks. A
    marker id in every set makes the same pass count the margins and P.
    """
    scratch = Scratch(turns.sparkSession, "arcs")
    sets = scratch.table(_turn_sets(turns, _checked(vocab, width), marker=width), "sets")
    cues = sets.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("ids").alias("l"))
    replies = sets.where("role = 'assistant'").select("conv_id", "turn", F.col("ids").alias("r"))
    rows = cues.join(replies, ["conv_id", "turn"])
    counts = scratch.table(pair_counts(rows, width + 1).drop("grp"), "counts")
    scratch.drop("sets")

    cue_n = counts.where((F.col("b") == width) & (F.col("a") < width)).select("a", F.col("n").alias("na"))
    resp_n = counts.where((F.col("a") == width) & (F.col("b") < width)).select("b", F.col("n").alias("nb"))
    total = counts.where((F.col("a") == width) & (F.col("b") == width)).select("n").scalar()
    n, a, b = F.col("n"), F.col("na"), F.col("nb")
    scored = (
        counts.where((F.col("a") < width) & (F.col("b") < width) & (n >= min_n))
        .join(cue_n, "a").join(resp_n, "b")
        .select(
            "a", "b", "n",
            F.round(n.cast("double") / a, 6).alias("conf"),
            F.round(scores.lift(n, a, b, total), 6).alias("lift"),
        )
    )
    return _named(scored, vocab, "cue", "resp").select("cue", "resp", "n", "conf", "lift")


def lagged_arcs(turns: DataFrame, vocab: DataFrame, width: int, k: int, min_n: int = 1) -> DataFrame:
    """Arcs per lag 1..k: pairs of turns that far apart with the cue earlier, the response later."""
    sets = Scratch(turns.sparkSession, "lags").table(_turn_sets(turns, _checked(vocab, width)), "sets")
    lags = F.explode(F.sequence(F.lit(1), F.lit(k)))
    early = sets.select("conv_id", "turn", F.col("ids").alias("l"), lags.alias("lag"))
    early = early.select("conv_id", (F.col("turn") + F.col("lag")).alias("turn"), "lag", "l")
    rows = early.join(sets.select("conv_id", "turn", F.col("ids").alias("r")), ["conv_id", "turn"])
    counts = pair_counts(rows, width, by="lag").where(F.col("n") >= min_n)
    return _named(counts.withColumnRenamed("grp", "lag"), vocab, "cue", "resp")


def subsumes(edges: DataFrame, stats: DataFrame, t: float = 0.8) -> DataFrame:
    """parent, child: P(parent | child) >= t and P(child | parent) below it."""
    na = stats.select(F.col("concept").alias("src"), F.col("df").alias("na"))
    nb = stats.select(F.col("concept").alias("dst"), F.col("df").alias("nb"))
    sides = F.array(
        F.struct(F.col("src").alias("parent"), F.col("dst").alias("child"), F.col("na").alias("np"), F.col("nb").alias("nc")),
        F.struct(F.col("dst").alias("parent"), F.col("src").alias("child"), F.col("nb").alias("np"), F.col("na").alias("nc")),
    )
    up, down = F.col("n") / F.col("nc"), F.col("n") / F.col("np")
    return (
        edges.join(na, "src").join(nb, "dst")
        .select("n", F.inline(sides))
        .where((up >= t) & (down < up))
        .select("parent", "child", "n", F.round(up, 6).alias("p_parent"), F.round(down, 6).alias("p_child"))
    )


def prune_topk(edges: DataFrame, k: int, min_n: int = 1, weight: str = "n") -> DataFrame:
    """Keep an edge that is among the k heaviest of either end; ties by the other end.

    The rank filter keeps k rows per node in each task before the shuffle, hubs included.
    """
    ends = both_ways(edges.where(F.col(weight) >= min_n), weight)
    w = Window.partitionBy("src").orderBy(F.desc(weight), "dst")
    return (
        ends.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= k)
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.max(weight).alias(weight))
    )


def prune_arcs(arcs: DataFrame, k: int, weight: str = "n") -> DataFrame:
    """Keep a directed arc that is among the k heaviest out of its cue or into its response."""
    out = Window.partitionBy("cue").orderBy(F.desc(weight), "resp")
    into = Window.partitionBy("resp").orderBy(F.desc(weight), "cue")
    best_out = arcs.withColumn("r", F.row_number().over(out)).where(F.col("r") <= k).drop("r")
    best_in = arcs.withColumn("r", F.row_number().over(into)).where(F.col("r") <= k).drop("r")
    return best_out.union(best_in).distinct()


def backbone(edges: DataFrame, alpha: float = 0.05, weight: str = "w") -> DataFrame:
    """Disparity filter: keep an edge with (1 - w/s)^(deg - 1) < alpha at either end.

    Edges are read three times, so they are written first.
    """
    edges = Scratch(edges.sparkSession, "backbone").table(edges.select("src", "dst", weight), "edges")
    ends = both_ways(edges, weight).groupBy("src").agg(F.count(F.lit(1)).alias("deg"), F.sum(weight).alias("s"))
    one = ends.select("src", F.col("deg").alias("deg_a"), F.col("s").alias("s_a"))
    two = ends.select(F.col("src").alias("dst"), F.col("deg").alias("deg_b"), F.col("s").alias("s_b"))

    def p(deg: str, s: str) -> Column:
        return F.pow(1 - F.col(weight) / F.col(s), F.col(deg) - 1)

    return (
        edges.join(one, "src").join(two, "dst")
        .withColumn("p", F.round(F.least(p("deg_a", "s_a"), p("deg_b", "s_b")), 6))
        .where(F.col("p") < alpha)
        .select("src", "dst", weight, "p")
    )


def merge_edges(edge_sets: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of the evidence `w` per pair; a missing set counts 0."""
    parts = [
        e.select("src", "dst", (F.col("w") * F.lit(float(weights[kind]))).alias("w"))
        for kind, e in edge_sets.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("src", "dst").agg(
        F.round(F.sum("w"), 6).alias("w"), F.count(F.lit(1)).alias("kinds")
    )
