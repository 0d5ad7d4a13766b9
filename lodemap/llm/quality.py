"""Document quality from supervised subword embeddings.

A document's features are its words, the character n-grams of its words and its word bigrams, each
hashed into a row of one table of learned vectors. Their mean is the document's vector, and a softmax
over two classes reads it. In a bigram a word that repeats one of the last RECENT words is written as
a back-reference, so that stuttering looks alike whatever word it repeats. Vectors and
softmax are trained together by stochastic gradient descent in numpy: shards of a bounded labelled
sample each take an epoch of steps from common weights, which are averaged after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodemap.llm.common import bucket_of, find, hash_words, mix, seeded_sample, slices, texts_of, words_of
from lodemap.scratch import Scratch

#: Labelled documents of each class that are used, about: FIT_SHARE for the vectors, the rest for the curve.
FIT_DOCUMENTS, FIT_SHARE = 3000, 0.75
#: Rows of the table of vectors, their width, and the character n-grams' lengths.
ROWS, WIDTH, SHORTEST, LONGEST = 1 << 15, 8, 2, 4
#: Words within which a repeated one is a back-reference.
RECENT = 4
#: Shards of the sample, rounds of one epoch each, documents of a step, and the first rate of learning.
SHARDS, ROUNDS, STEP, RATE = 4, 8, 16, 1.0
#: How much faster vectors learn than the softmax: each has only a small share in a mean.
GAIN = 100.0
#: Distinct words whose sums a task keeps between steps.
KEPT_WORDS = 1 << 18
THRESHOLD = 0.3


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and table row of the words themselves and their character n-grams, edges marked; by word."""
    marked = [f"<{word}>" for word in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    owner, row, key = [np.arange(len(words))], [hash_words(words)], chars
    for n in range(2, LONGEST + 1):
        key = mix(key[:-1], chars[n - 1 :])
        inside = of[: len(key)] == of[n - 1 :]
        if n >= SHORTEST:
            owner.append(of[: len(key)][inside])
            row.append(key[inside])
    owner, row = np.concatenate(owner), np.concatenate(row)
    order = np.argsort(owner, kind="stable")
    return owner[order], (row[order] % np.uint64(ROWS)).astype(np.int64)


def _sums(vectors: np.ndarray, at: np.ndarray, into: np.ndarray, n: int) -> np.ndarray:
    """Sums of vectors[at] by the ascending index `into` below n, in steps of bounded size."""
    out = np.zeros((n, vectors.shape[1]))
    for s in range(0, len(at), 1 << 16):
        here = into[s : s + (1 << 16)]
        first = _runs_of(here)
        out[here[first]] += np.add.reduceat(vectors[at[s : s + (1 << 16)]].astype(np.float64), first)
    return out


class Features:
    """Features of texts: their words, by index into the distinct ones, and table rows of word bigrams."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.row, words = words_of(texts)
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        self.word = coded.indices.to_numpy().astype(np.int64)
        name = hash_words([w.lower() for w in self.distinct])[self.word]
        back = np.zeros(len(name), np.uint64)
        for k in range(RECENT, 0, -1):
            same = np.zeros(len(name), bool)
            same[k:] = (name[k:] == name[:-k]) & (self.row[k:] == self.row[:-k])
            back[same] = k
        sign = np.where(back > 0, back, name)
        before = np.concatenate([np.zeros(1, np.uint64), sign[:-1]])[: len(sign)]
        before[_runs_of(self.row)] = 0
        self.pair = (mix(before, sign) % np.uint64(ROWS)).astype(np.int64)

    def bags(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct rows of each text and their shares of its features; both empty without words."""
        owner, part = _subwords(self.distinct)
        starts = np.searchsorted(owner, np.arange(len(self.distinct) + 1))
        ends = np.searchsorted(self.row, np.arange(self.n), side="right")
        begin = 0
        for end in ends:
            word, n = np.unique(self.word[begin:end], return_counts=True)
            size = starts[word + 1] - starts[word]
            at = np.repeat(starts[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            weight = np.bincount(part[at], weights=np.repeat(n, size), minlength=ROWS) + np.bincount(self.pair[begin:end], minlength=ROWS)
            used = np.flatnonzero(weight)
            yield used.astype(np.int32), (weight[used] / max(weight.sum(), 1)).astype(np.float32)
            begin = end


class Model(NamedTuple):
    vectors: np.ndarray  # ROWS x WIDTH
    out: np.ndarray      # WIDTH x 2
    bias: np.ndarray
    curve: np.ndarray    # slope and intercept on the difference of the classes' logits

    def margins(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        return z[:, 1] - z[:, 0]

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(hidden) * self.curve[0] + self.curve[1], -500, 500)))


class Reader:
    """Mean vectors of texts under one model; sums of words seen before are kept, up to KEPT_WORDS."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.forget()

    def forget(self) -> None:
        self.known, self.sums, self.sizes = np.zeros(0, np.uint64), np.zeros((0, self.vectors.shape[1])), np.zeros(0)

    def means(self, texts: pa.Array) -> np.ndarray:
        """Mean vector of each text; zeros for a text without words."""
        f = Features(texts)
        names = hash_words(f.distinct)
        if len(self.known) + len(names) > KEPT_WORDS:
            self.forget()
        new = np.flatnonzero(~find(self.known, names)[1])
        owner, part = _subwords([f.distinct[i] for i in new])
        known = np.concatenate([self.known, names[new]])
        order = np.argsort(known, kind="stable")
        self.sums = np.concatenate([self.sums, _sums(self.vectors, part, owner, len(new))])[order]
        self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(new))])[order]
        self.known = known[order]
        word = find(self.known, names)[0][f.word] if len(f.word) else f.word
        total = _sums(self.sums, word, f.row, f.n) + _sums(self.vectors, f.pair, f.row, f.n)
        size = np.bincount(f.row, weights=self.sizes[word] + 1, minlength=f.n)
        return total / np.maximum(size, 1)[:, None]


def _epoch(weights: tuple[np.ndarray, ...], bags: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weigh: np.ndarray, rate: float, seed: int):
    """Weights after one pass of gradient steps over a shard in a seeded order."""
    vectors, out, bias = (w.astype(np.float64) for w in weights)
    order = np.random.default_rng(seed).permutation(len(bags))
    for s in range(0, len(order), STEP):
        step = order[s : s + STEP]
        hidden = np.stack([bags[i][1] @ vectors[bags[i][0]] for i in step])
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(step)), good[step]] -= 1
        slope = p * weigh[step, None] / len(step)
        back = slope @ out.T
        out -= rate * hidden.T @ slope
        bias -= rate * slope.sum(0)
        for g, i in zip(back, step):
            vectors[bags[i][0]] -= rate * np.outer(bags[i][1], g) * GAIN
    return vectors.astype(np.float32), out.astype(np.float32), bias.astype(np.float32)


def _start() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.uniform(-1, 1, (ROWS, WIDTH)) / WIDTH).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)


def _curve(margin: np.ndarray, good: np.ndarray, weigh: np.ndarray) -> np.ndarray:
    """Slope and intercept of a logistic curve on the margin, by Newton steps with a small ridge."""
    a, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weigh * p * (1 - p))[:, None]) + 0.1 * np.eye(2), a.T @ (weigh * (good - p)) - 0.1 * (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, shares = zip(*Features(batch.column("text")).bags())
        ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.drop_columns("text").columns, *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in (rows, shares))],
            [*batch.drop_columns("text").schema.names, "rows", "shares"])


def _read_bags(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    rows, shares = batch.column("rows"), batch.column("shares")
    ends = rows.offsets.to_numpy()
    rows, shares = rows.values.to_numpy(), shares.values.to_numpy()
    return [(rows[a:b], shares[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> Model | None:
    """A model from the documents that `labels` (doc_id, quality) marks; None if either class is empty.

    The classes are a seeded sample of about `fit_documents` documents each, which bounds the model and
    what a shard holds. A document with both labels is of quality 0; null ids and labels other than
    0 and 1 are left out. The curve weighs the classes as all labels have them.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    scratch = Scratch(docs.sparkSession, "quality")
    marks = scratch.table(marks, "marks")
    whole = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    if len(whole) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1000))
    chosen = seeded_sample(marks, "good", "doc_id", fit_documents, "quality").withColumn("part", F.when(draw < int(1000 * FIT_SHARE), F.pmod(draw, F.lit(SHARDS))).otherwise(F.lit(SHARDS)).cast("int"))
    chosen = scratch.table(chosen, "chosen")  # bounded by the sample: texts need not be shuffled to meet it
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id").select("part", "good", "text")
    bags = scratch.table(texts.mapInArrow(_bags, "part int, good int, rows array<int>, shares array<float>"), "bags")
    sizes = {(r["part"], r["good"]): r["count"] for r in bags.groupBy("part", "good").count().collect()}
    for_fit = [sum(n for (part, good), n in sizes.items() if part < SHARDS and good == c) for c in (0, 1)]
    if not all(for_fit):
        return None
    # the rarer class counts for more, by the root of its share, so that neither is passed over
    balance = np.sqrt(sum(for_fit) / (2 * np.array(for_fit, float)))
    spark, weights = docs.sparkSession, _start()
    shards = bags.where(F.col("part") < SHARDS).repartition(SHARDS, "part").sortWithinPartitions("part")
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def train(batches: Iterator[pa.RecordBatch], number: int = number, sent=sent) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                part = batch.column("part").to_numpy()
                for p in np.unique(part):
                    held.setdefault(int(p), []).append(batch.filter(pa.array(part == p)))
            for part, own in held.items():
                bags_of = [bag for batch in own for bag in _read_bags(batch)]
                good = np.concatenate([batch.column("good").to_numpy() for batch in own]).astype(np.int64)
                order = np.lexsort([[len(b[0]) for b in bags_of], [float(b[1] @ b[0]) for b in bags_of]])  # alike however rows arrive
                new = _epoch(sent.value, [bags_of[i] for i in order], good[order], balance[good[order]], RATE * (1 - number / rounds), number * SHARDS + part)
                yield pa.RecordBatch.from_arrays([pa.array([len(good)]), *(pa.array([w.tobytes()], pa.binary()) for w in new)], ["n", "vectors", "out", "bias"])

        trained = shards.mapInArrow(train, "n long, vectors binary, out binary, bias binary").collect()  # SHARDS models of fixed size
        trained.sort(key=lambda r: (r["n"], bytes(r["vectors"][:64])))
        share = np.array([r["n"] for r in trained], float) / sum(r["n"] for r in trained)
        weights = tuple(
            sum(w * np.frombuffer(r[c], np.float32) for w, r in zip(share, trained)).astype(np.float32).reshape(old.shape)
            for c, old in zip(("vectors", "out", "bias"), weights))
        sent.destroy()
    model = Model(*weights, np.array([1.0, 0.0]))
    sent = spark.sparkContext.broadcast(tuple(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            hidden = [share @ model.vectors[rows] for rows, share in _read_bags(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(model.margins(np.array(hidden).reshape(-1, WIDTH)).astype(float)), batch.column("good")], ["margin", "good"])

    seen = bags.where(F.col("part") == SHARDS).mapInArrow(measure, "margin double, good int").toPandas().sort_values(["margin", "good"])
    sent.destroy()
    good = seen["good"].to_numpy(float)
    if 0 < good.sum() < len(good):
        share = np.array([whole[0], whole[1]]) / sum(whole.values()) / np.array([1 - good.mean(), good.mean()])
        model = model._replace(curve=_curve(seen["margin"].to_numpy(), good, share[good.astype(int)]))
    return model


def quality(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """`key`, score, predicted for every row of `docs`, from its whole text.

    A null or empty text, or one without words, has the score of the zero vector; without a model
    every score is 0.5. Repeated rows get a row each; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value) if sent.value else None
        reader = Reader(model.vectors) if model else None
        for batch in slices(batches):
            score = model.scores(reader.means(texts_of(batch))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(score.astype(float)), pa.array((score >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    columns = [key, "text"] if "text" in docs.columns else [key]
    return docs.select(columns).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def split_fit(docs: DataFrame, labels: DataFrame, buckets: int = 5, held: int = 0) -> Model | None:
    """A model from labelled documents outside the held-out fold."""
    return fit(docs, labels.where(bucket_of("doc_id", buckets) != held))


def good_enough(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` that are predicted to be of quality, with all their columns."""
    rows = docs.select(F.struct(F.col("*")).alias("doc"))
    return quality(rows, model, "doc").where("predicted = 1").select("doc.*")
