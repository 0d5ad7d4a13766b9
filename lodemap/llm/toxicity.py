"""Toxicity from two class-conditional Kneser-Ney models.

A bigram model of toxic text and one of ordinary text are fitted on labelled documents, each by
interpolated Kneser-Ney smoothing: a discounted bigram, and what the discount took off goes to the
continuation counts of the word in that class; what is taken off there goes to one distribution
that both share, the word counts of all documents. So every context of either class sums to 1.
An n-gram on which the classes do not clearly differ is discounted whole: its count goes down to
what they share, so a rare expression is as likely under both. A text is judged by the difference of its two log-likelihoods, normalised by length: the mean over the
whole text, its sum over the root of the length (whose noise is as wide at any length), and the
mean of its most toxic stretch of `WINDOW` words, so that a short insult in a long text is not
averaged away. A logistic curve fitted on labelled documents that the models have not seen turns
these into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F

from lodemap.llm.common import bucket_of, find, hash_words, mix, seeded_sample, slices, texts_of, tidy, words_of
from lodemap.scratch import Scratch

#: Labelled documents of each class that are used, about: FIT_SHARE for the models, the rest for the curve.
FIT_DOCUMENTS = 6000
FIT_SHARE = 0.75
#: Absolute discount of both levels: what is taken off at most from a count. An n-gram must be
#: used more often than this in a class to count for it by itself.
DISCOUNT = 2
#: Standard errors by which the classes must differ on an n-gram that counts by itself.
TELLING = 4.0
#: Part of every probability that both classes share, which bounds what one word can say.
SHARED = 0.1
WINDOW = 30
THRESHOLD = 0.7
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


class Model(NamedTuple):
    """Sorted hashes and what they stand for; columns are toxic, ordinary."""

    words: np.ndarray
    low: np.ndarray      # probability of a known word, below bigrams
    contexts: np.ndarray
    back: np.ndarray     # backoff weight of a known context (1 where the class never saw it)
    pairs: np.ndarray
    high: np.ndarray     # what a known bigram adds
    unseen: np.ndarray   # probability of any other word, below bigrams, up to a factor of both
    curve: np.ndarray    # weights of the features, then the intercept

    def likelihoods(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Probability of each word after the one before it."""
        at, known = find(self.words, word)
        low = np.tile(self.unseen, (len(word), 1))
        low[known] = self.low[at[known]]
        at, known = find(self.contexts, before)
        low[known] *= self.back[at[known]]
        at, known = find(self.pairs, pair)
        low[known] += self.high[at[known]]
        return (1 - SHARED) * low + SHARED * low.mean(1, keepdims=True)

    def ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text of each word, and the difference of its log-probabilities, toxic less ordinary."""
        row, *ngrams = _ngrams(texts)
        p = np.log(self.likelihoods(*ngrams))
        return row, p[:, 0] - p[:, 1]

    def features(self, texts: pa.Array) -> np.ndarray:
        """Mean, sum over the root of the length, most toxic stretch; zeros for a text without words."""
        row, ratio = self.ratios(texts)
        n = np.bincount(row, minlength=len(texts))
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        ends = np.cumsum(n)
        mean = (total[ends] - total[ends - n]) / np.maximum(n, 1)
        worst = np.full(len(texts), -np.inf)
        at = np.arange(len(row))
        start = np.maximum(at + 1 - WINDOW, (ends - n)[row])
        np.maximum.at(worst, row, (total[at + 1] - total[start]) / WINDOW)
        return np.stack([mean, mean * np.sqrt(n), np.where(n > 0, worst, 0.0)], 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.features(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash of the word before (0: none), hash, and hash of both, of words in order.

    A word after the same word counts once in a text: a repeated line says nothing new.
    """
    row, words = words_of(texts)
    coded = words.dictionary_encode()
    distinct = [w.lower().strip(EDGES) or w for w in coded.dictionary.to_pylist()]
    word = hash_words(distinct)[coded.indices.to_numpy()]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[: len(word)]
    pair = mix(np.where(first, np.uint64(0), before), word)
    _, once = np.unique(mix(row.astype(np.uint64), pair), return_index=True)
    once.sort()
    return row[once], np.where(first, np.uint64(0), before)[once], word[once], pair[once]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, before, word, pair, n, first): texts with the pair, and those whose first use of the word it is."""
    for batch in slices(batches):
        for toxic in (0, 1):
            texts = batch.column("text").filter(pc.equal(batch.column("toxic"), toxic))
            row, before, word, pair = _ngrams(texts)
            keys, at, of, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            first = np.zeros(len(row))
            first[np.unique(mix(row.astype(np.uint64), word), return_index=True)[1]] = 1
            first = np.bincount(of, first, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), toxic, np.int32)), _signed(before[at]), _signed(word[at]), _signed(keys), pa.array(n), pa.array(first)],
                ["toxic", "before", "word", "pair", "n", "first"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of every slice of texts."""
    for batch in slices(batches):
        _, found = words_of(batch.column("text"))
        coded = found.dictionary_encode()
        word = hash_words([w.lower().strip(EDGES) or w for w in coded.dictionary.to_pylist()])
        n = np.bincount(coded.indices.to_numpy(), minlength=len(word))
        yield pa.RecordBatch.from_arrays([_signed(word), pa.array(n)], ["word", "n"])


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; both classes weigh by their share. A text without any
    evidence, all features 0, is added to the ordinary ones, so that it is not judged by chance."""
    x, y = np.vstack([x, np.zeros(x.shape[1])]), np.append(y, 0.0)
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _telling(toxic: str, ordinary: str, whole: Row) -> Column:
    """Whether an n-gram counts by itself: in more than DISCOUNT texts of a class, and its two counts
    differ by more than TELLING standard errors from what the classes' sizes `whole` let expect."""
    sizes = whole[toxic] or 0, whole[ordinary] or 0
    share = sizes[0] / max(sum(sizes), 1)
    expected = (F.col(toxic) + F.col(ordinary)) * share
    return (F.greatest(toxic, ordinary) > DISCOUNT) & (F.abs(F.col(toxic) - expected) > TELLING * F.sqrt(expected * (1 - share)))


def _sorted(rows: pd.DataFrame, by: str) -> tuple[np.ndarray, pd.DataFrame]:
    """Hashes in ascending order, and the rows in that order."""
    keys = rows[by].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.iloc[order]


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model | None:
    """A model from the documents that `labels` (doc_id, toxic) marks; None if either class is empty.

    The classes are a seeded sample of about `fit_documents` documents each, which bounds the
    model; the shared backoff counts are of all `docs`. A document with both labels is toxic;
    null ids and labels other than 0 and 1 are left out.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = seeded_sample(marks, "toxic", "doc_id", fit_documents, "toxicity").withColumn(
        "fit", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1000)) < int(1000 * FIT_SHARE))
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = scratch.table(chosen, "chosen")  # bounded by the sample: texts need not be shuffled to meet it
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id").persist()
    counted = texts.where("fit").select("toxic", "text").mapInArrow(tidy(_count_ngrams), "toxic int, before long, word long, pair long, n long, first long")
    pairs = counted.groupBy("pair", "before", "word").agg(
        *[F.sum(F.when(F.col("toxic") == is_, F.col(n)).otherwise(0)).alias(c) for is_, c, n in ((1, "t", "n"), (0, "o", "n"), (1, "dt", "first"), (0, "do", "first"))])
    pairs = scratch.table(pairs, "pairs")
    sums = pairs.agg(*[F.sum(c).alias(c) for c in ("t", "o", "dt", "do")]).first()
    pairs = pairs.withColumn("used", _telling("t", "o", sums))
    # a word has as many kinds of contexts as one long text gives it, so texts tell whether it counts
    each = pairs.groupBy("word").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in "to"], *[F.sum(c).alias(c) for c in ("dt", "do")], F.max("used").alias("ends"))
    types = each.agg(*[F.sum(c).alias(c) for c in "to"]).first()
    if not types["t"] or not types["o"]:
        texts.unpersist()
        return None
    off = [F.sum(F.when(F.col("used"), F.least(F.col(c), F.lit(DISCOUNT))).otherwise(F.col(c))).alias(f"off_{c}") for c in "to"]
    each = each.withColumn("used", _telling("dt", "do", sums))
    taken = each.agg(*off).first()
    corpus = docs.select("text").mapInArrow(tidy(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    corpus = scratch.table(corpus, "corpus")
    size = corpus.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    # bounded by the sample, as the pairs and contexts are
    known = scratch.table(each.where("used OR ends").select("word", *"to", "used"), "known").join(corpus, "word").toPandas()
    high = pairs.where("used").select("pair", "before", "t", "o").toPandas()
    context = pairs.groupBy("before").agg(*[F.sum(c).alias(c) for c in "to"], *off, F.max("used").alias("used")).where("used").toPandas()

    words, known = _sorted(known, "word")
    whole = size["n"] + size["kinds"] + 1  # the last one is for words that no document has
    kinds = np.array([types["t"], types["o"]], float)
    rest = np.array([taken["off_t"], taken["off_o"]], float) / kinds
    own = np.maximum(known[["t", "o"]].to_numpy(float) - DISCOUNT, 0) * known[["used"]].to_numpy(bool)
    low = own / kinds + rest * (known[["n"]].to_numpy(float) + 1) / whole
    contexts, context = _sorted(context, "before")
    total = context[["t", "o"]].to_numpy(float)
    back = np.where(total > 0, context[["off_t", "off_o"]].to_numpy(float) / np.maximum(total, 1), 1.0)
    keys, high = _sorted(high, "pair")
    at, _ = find(contexts, high["before"].to_numpy().view(np.uint64))
    adds = np.maximum(high[["t", "o"]].to_numpy(float) - DISCOUNT, 0) / np.maximum(total[at], 1)
    model = Model(words, low, contexts, back, keys, adds, rest / whole, np.zeros(4))
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = Model(*held.value).features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), batch.column("toxic")], ["mean", "root", "worst", "toxic"])

    unseen_docs = texts.where("NOT fit").select("text", "toxic").mapInArrow(tidy(measure), "mean double, root double, worst double, toxic int").toPandas()
    texts.unpersist()
    if unseen_docs["toxic"].nunique() < 2:
        return model._replace(curve=np.array([1.0, 1.0, 1.0, -1.0]))
    return model._replace(curve=_curve(unseen_docs[["mean", "root", "worst"]].to_numpy(), unseen_docs["toxic"].to_numpy(float)))


def toxicity(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """`key`, score, predicted for every row of `docs`, from its whole text (its own or, without
    one, the field `text` of `key`).

    A null or empty text has the score of the curve at zero; without a model every score is 0.
    Repeated rows get a row each; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value) if held.value else None
        for batch in slices(batches):
            score = model.score(texts_of(batch)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    columns = [key, "text"] if "text" in docs.columns else [key]
    return docs.select(columns).mapInArrow(tidy(run), f"`{key}` {kind}, score double, predicted int")


def split_fit(docs: DataFrame, labels: DataFrame, buckets: int = 3, held: int = 1) -> Model | None:
    """A model from labelled documents outside the held-out fold; shared counts from all."""
    return fit(docs, labels.where(bucket_of("doc_id", buckets) != held))


def not_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    rows = docs.select(F.struct(F.col("*")).alias("doc"))
    return toxicity(rows, model, "doc").where("predicted = 0").select("doc.*")
