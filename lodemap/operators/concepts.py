"""Concept mentions: tokens, vocabulary, tf-idf, collocations, dictionary matches.

A *unit* is one row of text (a document or a turn). `token_units` keeps a unit's tokens as
one array, so everything that looks at neighbouring tokens stays inside the row and needs
no shuffle, however long one unit is. Arrays are exploded with the `_outer` generators:
the plain ones add a `size(array) > 0` filter below the tokeniser and run its regular
expression several times over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodemap.functions import scores, text as tx
from lodemap.scratch import Scratch


def token_units(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per unit: its key columns and `toks`, the ordered tokens."""
    return df.select(*keys, tx.words(text).alias("toks"))


def _keys(units: DataFrame) -> list[str]:
    return [c for c in units.columns if c != "toks"]


def unit_count(units: DataFrame) -> Column:
    """Number of units as a scalar subquery: evaluated with the plan, not on the driver."""
    return units.agg(F.count(F.lit(1))).scalar()


def tokens(units: DataFrame) -> DataFrame:
    """One row per token with its position, from 0."""
    return (
        units.select(*_keys(units), F.posexplode_outer("toks").alias("pos", "tok"))
        .where(F.col("tok").isNotNull())
    )


def ngrams(units: DataFrame, n: int) -> DataFrame:
    """Contiguous n-grams by position, as `gram` with its start `pos`."""
    rows = F.arrays_zip(*[tx.ahead("toks", k).alias(f"t{k}") for k in range(n)])
    return (
        units.select(*_keys(units), F.posexplode_outer(rows).alias("pos", "g"))
        .where(F.col(f"g.t{n - 1}").isNotNull())
        .select(*_keys(units), "pos", F.concat_ws(" ", *[f"g.t{k}" for k in range(n)]).alias("gram"))
    )


def fold_labels(df: DataFrame, col: str = "concept") -> DataFrame:
    """Merge accent and case variants: per folded label its spellings, tf and best form."""
    return (
        df.groupBy(tx.fold(col).alias("folded"))
        .agg(
            F.count(F.lit(1)).alias("n_forms"),
            F.sum("tf").alias("tf"),
            F.min(F.struct((-F.col("tf")).alias("neg_tf"), F.col(col).alias("form")))["form"].alias("best_form"),
        )
    )


def term_stats(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tf (occurrences) and df (units) per concept, per group when `by` is given.

    Each unit's tokens and then its distinct tokens go through one aggregation; the place in
    the joint list tells them apart. Map-side combining shrinks the shuffle to one row per
    concept and task; neither (unit, concept) rows nor a distinct aggregate are shuffled.
    """
    both = F.concat("toks", F.array_distinct("toks"))
    return (
        units.select(*by, F.size("toks").alias("n"), both.alias("both"))
        .select(*by, "n", F.posexplode_outer("both").alias("pos", "concept"))
        .where(F.col("concept").isNotNull())
        .groupBy(*by, "concept")
        .agg(F.count_if(F.col("pos") < F.col("n")).alias("tf"), F.count_if(F.col("pos") >= F.col("n")).alias("df"))
    )


def vocabulary(stats: DataFrame, n_units: Column | int, min_df: int = 2, max_df_frac: float = 0.2, *, top: int | None) -> DataFrame:
    """Concepts within the df band; with a `top`, the most frequent ones, numbered by `cid`.

    `cid` runs from 0 to top - 1, most frequent first; its window sees `top` rows only. Without
    a `top` there is no `cid`: only pair counting needs one, and a bounded vocabulary with it.
    """
    limit = n_units if isinstance(n_units, Column) else F.lit(n_units)
    kept = (
        stats.where(F.col("df") >= min_df)
        .where(F.col("df") <= F.lit(max_df_frac) * limit)
    )
    if top is None:
        return kept.select("concept", "tf", "df")
    kept = kept.orderBy(F.desc("df"), "concept").limit(top)
    order = Window.orderBy(F.desc("df"), "concept")
    return kept.select("concept", "tf", "df", (F.row_number().over(order) - 1).alias("cid"))


def mentions(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per unit and vocabulary concept in it, with tf."""
    keys = _keys(units)
    return (
        tokens(units)
        .join(vocab.select(F.col("concept").alias("tok")), "tok")
        .groupBy(*keys, F.col("tok").alias("concept"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def concept_sets(units: DataFrame, vocab: DataFrame, marker: int | None = None) -> DataFrame:
    """One row per unit with `ids`, the set of its concept ids.

    A set holds at most as many ids as the vocabulary, whatever the length of the unit. A
    unit without any concept has no row, unless a `marker` id is given: then every unit
    has that id in its set as well.
    """
    keys = _keys(units)
    toks = F.array_distinct("toks")
    known = vocab.select(F.col("concept").alias("tok"), F.col("cid").cast("int").alias("cid"))
    if marker is not None:
        # The empty string is never a token, so it can stand for the marker. A range has a
        # known size, so the union with the written vocabulary can still be broadcast.
        toks = F.concat(F.coalesce(toks, F.array().cast("array<string>")), F.array(F.lit("")))
        one = units.sparkSession.range(1).select(F.lit("").alias("tok"), F.lit(marker).cast("int").alias("cid"))
        known = known.unionByName(one)
    return (
        units.select(*keys, F.explode_outer(toks).alias("tok"))
        .where(F.col("tok").isNotNull())
        .join(known, "tok")
        .groupBy(*keys)
        .agg(F.collect_set("cid").alias("ids"))
    )


def quality_semi(docs: DataFrame, good: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is in `good`. Documents without a mark are not in it."""
    return docs.join(good.select(key).distinct(), key, "left_semi")


def dedup_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, copies: the smallest key of each text and how many documents have it.

    Texts meet by a 256-bit hash, so that no text is shuffled, and counts combine in each task.
    """
    return (
        docs.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("hash"))
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).drop("hash")
    )


def stopword_anti(toks: DataFrame, stop: DataFrame) -> DataFrame:
    """Tokens that are not in the stop list (column `concept`)."""
    return toks.join(stop.select(F.col("concept").alias("tok")), "tok", "left_anti")


def tfidf(ment: DataFrame, df_stats: DataFrame, n_units: Column | int) -> DataFrame:
    """Add `score` = tf * ln((N+1)/(df+1)) to mentions; `df_stats` has concept, df."""
    total = n_units if isinstance(n_units, Column) else F.lit(n_units)
    return (
        ment.join(df_stats.select("concept", "df"), "concept")
        .withColumn("score", F.round(scores.tfidf(F.col("tf"), F.col("df"), total), 6))
    )


def top_concepts(scored: DataFrame, by: Sequence[str], k: int, score: str = "score", tie: str = "concept") -> DataFrame:
    """The k best rows per group. Spark keeps k per group in each task before the shuffle,
    so a group of any size costs one task k rows per input task."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collocations(units: DataFrame, min_n: int = 2) -> DataFrame:
    """Adjacent pairs with count, PMI and log-likelihood; margins count pair positions."""
    pairs = (
        units.select(F.inline_outer(F.arrays_zip(F.col("toks").alias("a"), tx.ahead("toks", 1).alias("b"))))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    # The counts are read four times, for pairs, both margins and the total: write them.
    counts = Scratch(units.sparkSession, "collocations").table(
        pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "counts"
    )
    left = counts.groupBy("a").agg(F.sum("n").alias("na"))
    right = counts.groupBy("b").agg(F.sum("n").alias("nb"))
    total = counts.agg(F.sum("n")).scalar()
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    return (
        counts.where(n >= min_n)
        .join(left, "a")
        .join(right, "b")
        .select(
            F.col("a"), F.col("b"), n, na, nb,
            F.round(scores.pmi(n, na, nb, total), 6).alias("pmi"),
            F.round(scores.g2(n, na, nb, total), 6).alias("g2"),
        )
    )


def match_dictionary(units: DataFrame, dictionary: DataFrame, longest: int = 3) -> DataFrame:
    """Dictionary aliases (1 to `longest` words) at each position, longest match only.

    `dictionary` has alias, concept. Each length is one left join on its own n-gram, and
    the longest hit wins by `coalesce`, so no position is ever grouped or ranked.
    """
    keys = _keys(units)
    rows = F.arrays_zip(*[tx.ahead("toks", k).alias(f"t{k}") for k in range(longest)])
    out = (
        units.select(*keys, F.posexplode_outer(rows).alias("pos", "g"))
        .where(F.col("g.t0").isNotNull())
    )
    hits = []
    for size in range(longest, 0, -1):
        gram = F.concat_ws(" ", *[f"g.t{k}" for k in range(size)])
        out = out.withColumn(f"gram{size}", F.when(F.col(f"g.t{size - 1}").isNotNull(), gram))
        entry = dictionary.where(F.size(F.split("alias", " ")) == size).select(
            F.col("alias").alias(f"gram{size}"), F.col("concept").alias(f"hit{size}"), F.lit(size).alias(f"len{size}")
        )
        out = out.join(entry, f"gram{size}", "left")
        hits.append(size)
    return (
        out.select(
            *keys, "pos",
            F.coalesce(*[f"hit{s}" for s in hits]).alias("concept"),
            F.coalesce(*[f"len{s}" for s in hits]).alias("n_words"),
        )
        .where(F.col("concept").isNotNull())
    )


def approx_reach(units: DataFrame, key: str, rsd: float = 0.05) -> DataFrame:
    """Approximate number of distinct units per concept, from mergeable sketches."""
    return (
        units.select(key, F.explode_outer("toks").alias("concept"))
        .where(F.col("concept").isNotNull())
        .groupBy("concept")
        .agg(F.approx_count_distinct(key, rsd).alias("reach"))
    )


def concept_cube(ment: DataFrame, dims: Sequence[str] = ("lang", "source")) -> DataFrame:
    """tf and units per concept over every combination of `dims`, with its grouping id.

    Mentions are summed to (concept, dims) first; the cube multiplies only those sums.
    """
    return cube_of(ment.groupBy("concept", *dims).agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")), dims)


def cube_of(stats: DataFrame, dims: Sequence[str] = ("lang", "source")) -> DataFrame:
    """`concept_cube` from the statistics of `term_stats` by `dims`: no mention is a row."""
    base = stats.select("concept", *dims, F.col("tf").alias("tf0"), F.col("df").alias("n0"))
    sets = [[]]
    for d in dims:
        sets += [s + [d] for s in sets]
    return (
        base.groupingSets([["concept", *s] for s in sets], "concept", *dims)
        .agg(
            F.sum("tf0").alias("tf"),
            F.sum("n0").alias("units"),
            *[F.grouping(d).alias(f"all_{d}") for d in dims],
        )
    )
