"""Importance resampling towards a target by hashed word n-grams.

The n-grams of a document fall into buckets by the CRC-32 of their bytes. Every document is scanned
once: its words are joined by one space, and the running CRC is stored where a word starts and where
it ends. A CRC is linear over GF(2), so that of any run of words follows from two of these prefixes:
shift the one at the start by as many zero bytes as the run has, and the common part cancels out.
No n-gram is ever built as a string.

A document weighs as much as the log ratios of its buckets between target and corpus. Adding seeded
Gumbel noise and keeping the highest scores draws without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodemap.llm.common import numbered, slices
from lodemap.scratch import Scratch

#: Longest run of words, buckets, least words and share in percent of what is drawn, seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"

_LETTERS = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
#: A-Z lower-cased, and every other ASCII byte but digits and letters as a space.
NORMAL = bytes(b if b in _LETTERS else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def _zero_steps() -> np.ndarray:
    """Tables [k, byte of the register, its value]: the CRC register after 2**k zero bytes."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & 1, np.uint32(0xEDB88320), np.uint32(0))
    low = np.arange(256, dtype=np.uint32)
    tables = np.zeros((32, 4, 256), np.uint32)
    for j in range(4):
        tables[0, j] = register if j == 0 else low << np.uint32(8 * (j - 1))
    for k in range(1, 32):
        tables[k] = _step(tables[k - 1], tables[k - 1])
    return tables


def _step(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


STEPS = _zero_steps()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs as `zeros` more zero bytes leave them, without the constant that cancels out."""
    out, k, left = crc.copy(), 0, zeros.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _step(STEPS[k], out[odd])
        left, k = left >> 1, k + 1
    return out


def prefixes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Running CRCs where each word of a normalised text starts and ends, and the words' lengths."""
    words = text.encode().translate(NORMAL).split()
    starts, ends, crc, run = [], [], 0, zlib.crc32
    for word in words:
        starts.append(crc)
        crc = run(word, crc)
        ends.append(crc)
        crc = run(b" ", crc)
    return starts, ends, list(map(len, words))


def crcs(texts: list[str | None], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; text and CRC of every run of 1 to `longest` words."""
    starts, ends, sizes, counts = [], [], [], []
    for text in texts:
        a, b, n = prefixes(text or "")
        starts += a
        ends += b
        sizes += n
        counts.append(len(n))
    start, end, size, count = np.array(starts, np.uint32), np.array(ends, np.uint32), np.array(sizes, np.int64), np.array(counts, np.int64)
    row = np.repeat(np.arange(len(texts)), count)
    until = np.cumsum(size + 1)  # each word and a space
    rows, found = [], []
    for n in range(1, longest + 1):
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        length = until[at + n - 1] - 1 - (until[at] - size[at] - 1)
        rows.append(row[at])
        found.append(end[at + n - 1] ^ shifted(start[at], length))
    return count, np.concatenate(rows), np.concatenate(found)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many n-grams of all texts fall into each used bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            _, _, crc = crcs(batch.column("text").to_pylist(), longest)
            seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """What an n-gram in each bucket adds to a weight, in thousandths; the driver gets `buckets` counts."""

    def counts(df: DataFrame) -> tuple[list[int], int]:
        out = [0] * buckets
        for row in bucket_counts(df, longest, buckets).collect():
            out[row["bucket"]] = row["n"]
        return out, sum(out)

    (s, whole_s), (t, whole_t) = counts(docs), counts(target)
    ratio = [float(b + 1) * float(whole_s + buckets) / (float(a + 1) * float(whole_t + buckets)) for a, b in zip(s, t)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, key: str = "doc_id") -> DataFrame:
    """`key`, n_words, n_features and weight of every row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, row, crc = crcs(batch.column("text").to_pylist(), longest)
            features = np.bincount(row, minlength=batch.num_rows)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gain[crc % np.uint32(len(gain))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(words), pa.array(features), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """`key`, n_features, weight, score, rank for every row of `docs`; rank is null for rows not drawn.

    Null and empty texts, and texts without words, have no features and weight 0; they are scored but
    never drawn. An empty target or corpus counts 0 in every bucket. Of the N rows with `least_words`
    words or more, floor(percent * N / 100) are drawn. Ties of score go to the smaller key, a null key
    last; repeated rows count, weigh and are drawn one by one. A null key is seeded as an empty one.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(docs, gains(docs, target, longest, buckets), longest, key)
    scored = scratch.table(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    placed = numbered(scored.where(enough), [F.desc("score"), F.asc_nulls_last(key), F.col("n_features")], scratch, "placed")
    ranked = placed.withColumn("rank", F.when(F.col("nth") <= drawn, F.col("nth")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = [key, "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))
