"""Mixing sources to target weights by fitting budgets as subset sums.

A source whose target is r times its size takes floor(r) whole passes. What is left of its target
is a budget for one more copy of some of its documents. Documents of one length are alike for a
budget, so it is fitted on counts by length: a proportional share of every length first, then whole
documents from the longest length down, then an exact bounded-knapsack table over the last
`TABLE` words. A document at a time never enters it. Documents of a length are then chosen by a
seeded hash, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from lodemap.llm.common import WORD
from lodemap.scratch import Scratch

#: Fixed values of the mix: weights by the order of sources, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words that the knapsack table covers.
TABLE = 1 << 18
#: Documents of one source and length in a bucket that is ranked, about.
GROUP = 1000
SEED = "mix"


def size(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, none above `most` times its source.

    Sources in code point order (null last) have the weights in turn. Sources are filled to their
    cap in the order in which a rising level reaches it; the others share what is left by weight,
    which is where repeated resharing of the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = (most * F.col("source_size")).cast("double")
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(after)
    capped = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= cap)
    free = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return capped.select("source", "source_size", F.when(F.col("full"), cap).otherwise(free * F.col("w")).alias("target"))


def fit(length: np.ndarray, count: np.ndarray, budget: float, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take for a sum as near to `budget` as this finds.

    Never above the counts. The sum is exact if the last `table` words can be made up from the
    documents that are left; else it is the nearest sum below or above that they make.
    """
    take = np.zeros(len(length), np.int64)
    whole = int((length * count).sum())
    if budget <= 0 or whole == 0:
        return take
    if budget >= whole:
        return np.where(length > 0, count, 0)
    # a proportional share of every length, short of the table's words
    part = max(0.0, (budget - table / 2) / whole)
    take = np.where(length > 0, np.floor(count * part), 0).astype(np.int64)
    rest = round(budget) - int((take * length).sum())
    room = max(table // 2, int(length[length > 0].min()))
    for i in np.argsort(-length, kind="stable"):  # longest first, until the table can hold the rest
        if rest <= room or length[i] == 0:
            break
        more = min(int(count[i] - take[i]), (rest - room + int(length[i]) - 1) // int(length[i]), rest // int(length[i]))
        take[i] += more
        rest -= more * int(length[i])
    if rest <= 0:
        return take
    exact = budget - int((take * length).sum())
    rest = round(exact)
    # bounded knapsack: reachable sums as the bits of one number, counts split by powers of two
    limit = min(rest + int(length[length > 0].max()), rest + table)
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(length, kind="stable"):
        left = int(count[i] - take[i])
        if length[i] == 0 or length[i] > limit or left <= 0:
            continue
        left, power = min(left, limit // int(length[i])), 1
        while left > 0 and not (reach >> rest) & 1:
            n = min(power, left)
            more = reach | (reach << (n * int(length[i]))) & mask
            if more != reach:
                steps.append((i, n, reach))
            reach, left, power = more, left - n, power * 2
        if (reach >> rest) & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    over = reach >> (rest + 1)
    above = rest + (over & -over).bit_length() if over else None
    at = above if above is not None and above - exact < exact - below else below
    for i, n, before in reversed(steps):
        if not (before >> at) & 1:
            take[i] += n
            at -= n * int(length[i])
    return take


def _draw(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, draw of every row."""
    return docs.select("doc_id", "source", size().alias("size"), _draw(seed).alias("draw"))


def _per_source(most: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        passes = min(most, int(target // whole)) if whole else 0
        extra = fit(g["size"].to_numpy(), g["n"].to_numpy(), target - passes * whole) if passes < most else 0
        return g.assign(passes=passes, extra=extra)[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    return run


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source and length: whole passes, and the draw up to which documents are taken once more.

    `cut` is the last draw that is taken (null: none, or all if `extra` = `n`), `at_cut` how many
    rows have it and `ties` how many of those are taken: all of them, but for repeated ids.
    """
    scratch = Scratch(sized.sparkSession, "mixing")
    counts = scratch.table(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    goals = scratch.table(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")
    lengths = counts.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target")
    plans = scratch.table(lengths.groupBy("source").applyInPandas(
        _per_source(most), "source string, size long, n long, source_size long, target double, passes long, extra long"), "plans")

    # documents of a length lie in buckets of about GROUP by their draw; buckets are filled in order
    key = ["source", "size"]
    partly = plans.where("extra > 0 AND extra < n").select(*key, "n", "extra")
    place = F.floor((F.col("draw").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("n") / GROUP)).alias("bucket")
    drawn = scratch.table(_on_length(sized.select(*key, "draw"), partly).select(*key, "draw", place, "extra"), "drawn")
    filled = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = drawn.groupBy(*key, "bucket", "extra").agg(F.count(F.lit(1)).alias("m"))
    last = (buckets.withColumn("quota", F.col("extra") - F.coalesce(F.sum("m").over(filled), F.lit(0)))
            .where("quota > 0 AND quota <= m").select(*key, "bucket", "quota"))
    last = scratch.table(last, "last")
    inside = (drawn.alias("a").join(last.alias("b"), [_same("source"), *(F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("size", "bucket"))])
              .select("a.source", "a.size", "a.bucket", "a.draw", "b.quota"))
    bucket = Window.partitionBy(*key, "bucket")
    ranked = inside.withColumn("rank", F.row_number().over(bucket.orderBy("draw")))
    ranked = ranked.withColumn("cut", F.max(F.when(F.col("rank") <= F.col("quota"), F.col("draw"))).over(bucket))
    at = F.col("draw") == F.col("cut")
    cuts = scratch.table(ranked.groupBy(*key).agg(
        F.max("cut").alias("cut"), F.sum(at.cast("long")).alias("at_cut"), F.sum((at & (F.col("rank") <= F.col("quota"))).cast("long")).alias("ties")), "cuts")
    full = plans.alias("a").join(cuts.alias("b"), [_same("source"), F.col("a.size") == F.col("b.size")], "left")
    return scratch.table(full.select("a.*", "b.cut", "b.at_cut", "b.ties"), "plan")


def _same(column: str) -> Column:
    return F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))


def _on_length(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    other = [c for c in lengths.columns if c not in ("source", "size")]
    return rows.alias("a").join(lengths.alias("b"), [_same("source"), F.col("a.size") == F.col("b.size")]).select("a.*", *(f"b.{c}" for c in other))


def copies(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """`sized` (source, size, draw and any others) with source_size, target and copies, how often a row is taken.

    Null texts and texts without words have size 0 and are never taken beyond their source's whole
    passes. A source's words come to its target to within half a word wherever the knapsack finds
    such a sum. Of repeated rows with one id as many are taken as are needed.
    """
    rows = _on_length(sized, plans)
    once = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("cut").isNull(), 0).when(F.col("draw") <= F.col("cut"), 1).otherwise(0)
    torn = F.coalesce((F.col("draw") == F.col("cut")) & (F.col("ties") < F.col("at_cut")), F.lit(False))
    kept = rows.withColumn("copies", F.col("passes") + once)
    if not plans.where("ties < at_cut").isEmpty():  # only where an id repeats
        rank = F.row_number().over(Window.partitionBy("source", "size", "draw").orderBy("draw"))
        shared = rows.where(torn).withColumn("copies", F.col("passes") + (rank <= F.col("ties")).cast("int"))
        kept = kept.where(~torn).unionByName(shared)
    return kept.drop("draw", "n", "passes", "extra", "cut", "at_cut", "ties")


def written_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """`sizes`, written, so that the texts are read once."""
    return Scratch(docs.sparkSession, "mixing").table(sizes(docs, seed), "sizes")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    plans = plan(written_sizes(docs, seed), weights, share, most)
    rows = docs.select(F.struct(F.col("*")).alias("doc"), "source", size().alias("size"), _draw(seed).alias("draw"))
    taken = copies(rows, plans).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc.*")
