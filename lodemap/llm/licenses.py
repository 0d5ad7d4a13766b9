"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Multinomial logistic regression over sparse word n-grams tells licence families from other text.
It is trained on notices of the families among words of the corpus itself, on a seeded sample of its
paragraphs, and on sentences that only talk of licences. Features are all words of the notices and
their pairs, however common they are in the corpus. A paragraph without a feature that could make it
a licence is passed by after one look at its words. A family is confirmed when
a notice's word pairs are found in the paragraph. A paragraph is a line, or adjacent lines without
a blank one between them over which a notice is wrapped: as few lines as confirm its family. A paragraph that looks like a licence, but whose
family is not sure enough or not confirmed, is `unknown`; how sure is enough is set on held-out
examples.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from lodemap.scratch import Scratch

#: Notices of each licence family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Distributed under the terms of the GNU General Public License v2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the MIT License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    ],
}
#: Sentences with words of notices that license nothing.
TALK = [
    "The driver lost his license after the accident.", "You need a permission from the public office.",
    "The source of the river is free of charge.", "Any person may use the library under the terms of the law.",
    "The version of the project was released in spring.", "A license to fish costs nothing.",
    "Copyright law is subject to change.", "The general public waived at the author.",
    "The foundation published a copy of the work.", "Conditions under the sea are not met.",
]
#: Paragraphs of the corpus in the training set, about; copies of each notice among corpus words.
NEGATIVES, COPIES = 2000, 6
#: Words found outside notices in more than this share of sampled paragraphs do not tell notices from other text.
RARE = 0.005
#: Share of the word pairs of a notice that must be in a paragraph, and least probability of a family.
CONFIRM, LEAST = 0.8, 0.5
NONE, UNKNOWN = "none", "unknown"


def tokens(text: str | Column) -> Column:
    """Lower-cased words: runs of letters, digits, dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def pairs(words: Column) -> Column:
    """Adjacent words, joined by a space."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(
        F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    return F.concat(words, pairs(words))


class Model(NamedTuple):
    """Words without which no paragraph is a licence, weights of every feature for each family, intercepts, and the least probability."""

    words: list[str]
    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    least: float


def _rows(spark: SparkSession, columns: list[str], values: list[tuple]) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in values])
    return spark.range(1).select(F.inline(rows))


def _notices(spark: SparkSession) -> DataFrame:
    named = [(family, text) for family, texts in sorted(NOTICES.items()) for text in texts]
    return _rows(spark, ["family", "notice"], [(f, t) for f, t in named])


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, copy, first, last, words of every line with words; `copy` is a hash of the text."""
    lines = docs.where("text IS NOT NULL").select(F.col(key), F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", r"\R")).alias("first", "line"))
    return lines.select(key, "copy", "first", F.col("first").alias("last"), tokens("line").alias("words"))


def _known(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Families and distinct word pairs of all notices."""
    return [(r["family"], r["pairs"]) for r in _notices(spark).select("family", F.array_distinct(pairs(tokens("notice"))).alias("pairs")).collect()]


def _all(known: list[tuple[str, list[str]]]) -> list[str]:
    return sorted({p for _, ps in known for p in ps})


def _confirms(words: Column, known: list[tuple[str, list[str]]], family: Column | None = None) -> Column:
    """Whether the pairs of a notice, of this or of any family, are among the pairs of `words`."""
    notices = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, ps)).alias("pairs")) for f, ps in known])
    held = lambda words: F.array_distinct(F.filter(pairs(words), lambda p: p.isin(_all(known))))
    enough = lambda t, held: F.size(F.array_intersect(t["pairs"], held)) >= CONFIRM * F.size(t["pairs"])
    fits = lambda held: F.exists(notices, lambda t: enough(t, held) if family is None else (t["family"] == family) & enough(t, held))
    # arrays of one, so that words and pairs are computed once
    return F.exists(F.array(words), lambda words: F.exists(F.array(held(words)), lambda held: (F.size(held) > 0) & fits(held)))


def wrapped(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, copy, first, last, words of runs of two or more lines that hold most of a notice.

    No run has a line without words, and none goes on after as many words as the longest notice has.
    """
    notices = _notices(docs.sparkSession).select(tokens("notice").alias("words"))
    longest = notices.agg(F.max(F.size("words"))).first()[0]
    known = _known(docs.sparkSession)
    n = F.size("lines")
    lines = docs.where("text IS NOT NULL").select(key, F.xxhash64("text").alias("copy"), F.transform(F.split("text", r"\R"), tokens).alias("lines"))
    lines = lines.where(n > 1).where(_confirms(F.flatten("lines"), known))
    # a first line that adds a pair, and what may follow it
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.arrays_overlap(
        pairs(F.concat(F.get("lines", i), F.slice(F.coalesce(F.get("lines", i + 1), F.array().cast("array<string>")), 1, 1))), F.lit(_all(known))))
    starts = lines.select(key, "copy", F.explode(F.transform(begins, lambda i: F.struct(i.alias("first"), F.slice("lines", i + 1, longest + 1).alias("part")))).alias("s")).select(key, "copy", "s.first", "s.part")
    before = lambda k: F.size(F.flatten(F.slice("part", 2, k - 1)))
    more = F.filter(F.sequence(F.lit(1), F.size("part") - 1), lambda k: (before(k) < longest) & F.forall(F.slice("part", 1, k + 1), lambda l: F.size(l) > 0))
    runs = starts.where(F.size("part") > 1).select(key, "copy", "first", "part", F.explode(more).alias("k"))
    runs = runs.select(key, "copy", "first", (F.col("first") + F.col("k")).alias("last"), F.flatten(F.slice("part", F.lit(1), F.col("k") + 1)).alias("words"))
    return runs.where(_confirms(F.col("words"), known))


def fit(docs: DataFrame, key: str = "doc_id") -> Model:
    """A model whose negatives are about NEGATIVES paragraphs of `docs`, one from each of as many documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("licenses"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    some = docs.where("text IS NOT NULL").where(draw * n < NEGATIVES)
    lines = some.select(F.split("text", r"\R").alias("lines")).select(tokens(F.element_at("lines", (F.pmod(F.xxhash64("lines"), F.size("lines")) + 1).cast("int"))).alias("words"))
    negatives = scratch.table(lines.withColumn("id", F.xxhash64("words")), "negatives")
    whole = max(1, negatives.count())
    notices = _notices(spark).withColumn("words", tokens("notice"))
    words = sorted(r["word"] for r in notices.select(F.explode("words").alias("word")).distinct().collect())  # bounded by the notices
    bigrams = _all(_known(spark))
    # words that are common where no pair of a notice is; copies of notices do not count
    inside = negatives.select("words", F.transform(pairs(F.col("words")), lambda p: p.isin(bigrams)).alias("known"))
    outside = inside.select(F.explode(F.array_distinct(F.filter(
        "words", lambda w, i: ~F.coalesce(F.get("known", i - 1), F.lit(False)) & ~F.coalesce(F.get("known", i), F.lit(False))))).alias("word"))
    counts = {r["word"]: r["n"] for r in outside.where(F.col("word").isin(words)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = {w for w in words if counts.get(w, 0) <= RARE * whole}
    telling = [p for p in bigrams if rare.intersection(p.split(" "))]
    # notices alone and among words of the corpus; sampled paragraphs without a notice's pairs; talk
    clean = negatives.where(F.size(F.array_intersect(pairs(F.col("words")), F.lit(telling))) < 2)
    noise = clean.where(F.size("words") > 4).orderBy("id").limit(COPIES).select(F.row_number().over(Window.orderBy("id")).alias("copy"), F.col("words").alias("noise"))
    around = notices.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).join(noise, "copy").withColumn("words", F.concat("noise", "words", "noise"))
    talk = _rows(spark, ["text"], [(t,) for t in TALK]).select(F.lit(NONE).alias("family"), tokens("text").alias("words"))
    examples = (notices.select("family", "words").union(around.select("family", "words")).union(talk)
                .union(clean.select(F.lit(NONE), "words")).withColumn("held", F.pmod(F.xxhash64("words"), F.lit(4)) == 0))
    families = [NONE, *sorted(NOTICES)]
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    features = CountVectorizerModel.from_vocabulary(words + bigrams, inputCol="grams", outputCol="features").setBinary(True)
    ready = features.transform(examples.withColumn("label", label).withColumn("grams", grams(F.col("words")))).select("label", "features", "held").coalesce(1).cache()
    lr = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, elasticNetParam=0.2)
    # every notice itself trains; of the rest a quarter is held out
    fitted = lr.fit(ready.where(~F.col("held")))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    scored = fitted.transform(ready.where("held")).select("label", _most("probability").alias("p"))
    bound = scored.where("label = 0").agg(F.max("p")).first()[0] or 0.0
    ready.unpersist()
    k = len(matrix)
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(words + bigrams) if matrix[:, i].any()}
    intercepts = [float(x) for x in intercepts]
    return Model(_needed(weights, intercepts, counts), families[:k], weights, intercepts, max(LEAST, min(0.95, float(bound))))


def _needed(weights: dict[str, list[float]], intercepts: list[float], counts: dict[str, int]) -> list[str]:
    """Words, one of which is in every paragraph that is a licence by these weights.

    All features that are not strong, taken together, leave every family below NONE's share of one
    half. `counts` chooses the rarer word of a strong pair, which changes cost only.
    """
    gain = {g: max(0.0, max(x - w[0] for x in w[1:])) for g, w in weights.items()}
    left = -log(len(intercepts) - 1) - max(x - intercepts[0] for x in intercepts[1:])
    strong = set()
    for g in sorted(gain, key=lambda g: (gain[g], g)):
        left -= gain[g]
        if left <= 0:
            strong.add(g)
    return sorted({min(g.split(" "), key=lambda w: (counts.get(w, 0), w)) for g in strong})


def _most(column: str) -> Column:
    p = vector_to_array(column)
    return F.array_max(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))


def classify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """`key`, first, last, family, score of every paragraph that is a licence or looks like one: its lines."""
    spark = docs.sparkSession
    k = len(model.families)
    # rows of one key may repeat: they are told apart by their texts' hashes
    hit = paragraphs(docs, key).where(F.exists("words", lambda w: w.isin(model.words))).unionByName(wrapped(docs, key))
    table = _rows(spark, ["gram", "w"], [(g, w) for g, w in sorted(model.weights.items())])
    seen = hit.withColumn("gram", F.explode(F.array_distinct(grams(F.col("words"))))).join(F.broadcast(table), "gram")  # as many rows as the notices have n-grams
    logits = seen.groupBy(key, "copy", "first", "last", "words").agg(*[(F.sum(F.col("w")[j]) + model.intercepts[j]).alias(f"z{j}") for j in range(k)])
    top = F.greatest(*[F.col(f"z{j}") for j in range(k)])
    mass = sum((F.exp(F.col(f"z{j}") - F.col("top")) for j in range(k)), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.col(f"z{j}").alias("z"), F.lit(f).alias("family")) for j, f in enumerate(model.families) if j]))
    scored = logits.withColumn("top", top).withColumn("mass", mass).withColumn("best", best).select(
        key, "copy", "first", "last", "words", F.col("best.family").alias("family"),
        (F.exp(F.col("best.z") - F.col("top")) / F.col("mass")).alias("score"), (F.exp(F.col("z0") - F.col("top")) / F.col("mass")).alias("none"))
    likely = scored.where("none < 0.5")
    sure = (F.col("score") >= model.least) & _confirms(F.col("words"), _known(spark), F.col("family"))
    named = likely.select(key, "copy", "first", "last", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "score")
    # of runs with a family those without a smaller one inside; lines of no sure family that are in none of them
    named = named.where((F.col("family") != UNKNOWN) | (F.col("first") == F.col("last")))
    later = Window.partitionBy(key, "copy", "family").orderBy(F.desc("first"), "last").rowsBetween(Window.unboundedPreceding, -1)
    least = named.withColumn("inner", F.min("last").over(later)).where((F.col("family") == UNKNOWN) | F.col("inner").isNull() | (F.col("inner") > F.col("last")))
    # runs of one family that share lines are one paragraph
    order = Window.partitionBy(key, "copy", "family").orderBy("first")
    apart = least.withColumn("begins", F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True)).cast("int")).withColumn("part", F.sum("begins").over(order))
    apart = apart.groupBy(key, "copy", "family", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("score").alias("score"))
    reached = Window.partitionBy(key, "copy").orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.max(F.when(F.col("family") != UNKNOWN, F.col("last"))).over(reached)
    return apart.withColumn("ends", ends).where((F.col("family") != UNKNOWN) | F.col("ends").isNull() | (F.col("ends") < F.col("first"))).select(key, "first", "last", "family", "score")


def scan(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """`key`, license, families, n_paragraphs, score for every row of `docs`.

    A paragraph is a line, or the few lines over which a notice is wrapped.
    license is the surest family of the document, `unknown` if only paragraphs of unknown licences
    are there, null without any; families lists all in order. Null and empty texts have none. Rows
    that share a key share their findings. Other columns are not read.
    """
    found = classify(docs, model, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.array_sort(F.collect_set("family")).alias("families"),
        F.max(F.struct((F.col("family") != UNKNOWN).alias("sure"), "score", "family")).alias("best"))
    found = Scratch(docs.sparkSession, "licenses").table(found, "found")
    out = docs.select(key).alias("a").join(found.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left")
    return out.select(
        f"a.{key}", F.col("b.best.family").alias("license"), F.coalesce("b.families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("b.n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("b.best.score", F.lit(0.0)).alias("score"))
