"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `ORDER` bytes. A byte costs the exact code
length that PPM with escapes (method C, no exclusions) gives it under the frozen counts: the
longest context that has seen the byte codes it, every longer known context costs an escape,
and below order 0 all 256 bytes are equally likely. A text belongs to the language that codes
it in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodemap.llm.common import bucket_of, find, seeded_sample, slices, texts_of, tidy

ORDER = 3
#: Labelled texts of each language that the trees are fitted on, about.
FIT_TEXTS = 300
#: Distinct grams whose costs a task keeps between steps.
KEPT_GRAMS = 1 << 20
#: Bytes of evidence that the score's posterior is tempered to.
SCORE_BYTES = 32
UNKNOWN = "und"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of all texts, each after ORDER zero bytes, and the padded lengths."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    padded = pc.binary_join_element_wise("\0" * ORDER, low, "")
    if len(padded) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    sizes = pc.binary_length(padded).to_numpy().astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(padded)], pa.int32()), padded), "")
    return np.frombuffer(joined[0].as_buffer(), np.uint8), sizes


def _grams(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 bytes ending at each real byte, and their number in each text."""
    codes = data.astype(np.uint32)
    for k in range(1, ORDER + 1):
        codes[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    real = np.ones(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER):
        real[starts + k] = False
    return codes[real], sizes - ORDER


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for lang in pc.unique(batch.column("lang")).to_pylist():
            codes, _ = _grams(*_bytes(batch.column("text").filter(pc.equal(batch.column("lang"), lang))))
            gram, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Trees:
    """Context counts of all languages, frozen; `cost` gives bits for grams."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.orders = langs, []
        for lang in langs:
            grams, n = counts[lang]
            levels = []
            for k in range(ORDER + 1):
                keys, at = np.unique(grams & np.uint32((1 << (8 * (k + 1))) - 1), return_inverse=True)
                seen = np.bincount(at, weights=n, minlength=len(keys))
                context, back = np.unique(keys >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(back, weights=seen), np.bincount(back)
                levels.append((keys, np.log2(seen), context, np.log2(total + kinds), np.log2(total + kinds) - np.log2(kinds)))
            self.orders.append(levels)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram, one column for each language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        for j, levels in enumerate(self.orders):
            open_, bits = np.ones(len(grams), bool), np.zeros(len(grams))
            for k in range(ORDER, -1, -1):
                keys, seen, context, whole, escape = levels[k]
                key = grams & np.uint32((1 << (8 * (k + 1))) - 1)
                at, hit = find(keys, key)
                here, known = find(context, key >> np.uint32(8))
                coded, escaped = open_ & hit, open_ & known & ~hit
                bits[coded] += whole[here[coded]] - seen[at[coded]]
                bits[escaped] += escape[here[escaped]]
                open_ &= ~hit
            bits[open_] += 8
            out[:, j] = bits
        return out


def fit(labelled: DataFrame, fit_texts: int = FIT_TEXTS) -> Trees:
    """Trees from text and lang of `labelled`, over a seeded sample of about `fit_texts` texts a language.

    Counting runs on the executors; what reaches the driver is bounded by the sample.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = seeded_sample(rows, "lang", "doc_id", fit_texts, "langid").select("lang", "text")
    counts = sample.mapInArrow(tidy(_count_batches), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    by = {lang: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for lang, g in counts.groupby("lang")}
    return Trees(sorted(by), by)


def identify(docs: DataFrame, trees: Trees, key: str = "doc_id") -> DataFrame:
    """`key`, lang_pred, score for every row of `docs`, from its whole text (its own or, without
    one, the field `text` of `key`).

    Null texts, texts without a letter and every text when no language is learned get `und` and
    score 0. Equal lengths go to the first language by code point. The score is the posterior of
    the language under equal priors, with the evidence tempered to SCORE_BYTES bytes. Repeated
    rows get a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = [*trees.langs, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known, cost = shared.value, np.zeros(0, np.uint32), np.zeros((0, len(names) - 1), np.float32)
        for batch in slices(batches):
            texts = texts_of(batch)
            codes, sizes = _grams(*_bytes(texts))
            new = np.unique(codes)
            new = new[~find(known, new)[1]]
            if len(known) + len(new) > KEPT_GRAMS:
                known, new, cost = known[:0], np.unique(codes), cost[:0]
            known, cost = np.concatenate([known, new]), np.concatenate([cost, trees.cost(new)])
            order = np.argsort(known, kind="stable")
            known, cost = known[order], cost[order]
            at, ends = np.searchsorted(known, codes), np.cumsum(sizes)
            bits = np.zeros((len(sizes), len(names) - 1))
            for j in range(bits.shape[1]):
                run_ = np.concatenate([[0.0], np.cumsum(cost[:, j][at], dtype=np.float64)])
                bits[:, j] = run_[ends] - run_[ends - sizes]
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if bits.shape[1]:
                best = np.where(letter, bits.argmin(1), len(names) - 1)
                gap = (bits - bits.min(1, keepdims=True)) / np.maximum(sizes, 1)[:, None]
                score = np.where(letter, 1 / np.exp2(-gap * SCORE_BYTES).sum(1), 0.0)
            else:
                best, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names).take(pa.array(best)), pa.array(score)], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    columns = [key, "text"] if "text" in docs.columns else [key]
    return docs.select(columns).mapInArrow(tidy(run), f"`{key}` {kind}, lang_pred string, score double")


def known_language(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of `docs` whose text is in a learned language, with all their columns."""
    rows = docs.select(F.struct(F.col("*")).alias("doc"))
    return identify(rows, trees, "doc").where(F.col("lang_pred") != UNKNOWN).select("doc.*")


def split_fit(docs: DataFrame, buckets: int = 4, held: int = 2) -> Trees:
    """Trees from the documents outside the held-out fold."""
    return fit(docs.where(bucket_of("doc_id", buckets) != held))
