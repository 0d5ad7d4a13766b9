"""Helpers that several operators share: bounded slices of Arrow batches, words, seeded samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodemap.scratch import Scratch

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of an Arrow task handles; one longer text is a step of its own.
SLICE_BYTES = 3 << 20


#: The C library's own way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give freed memory back to the system: a Python worker serves stage after stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Task) -> Task:
    """`run`, followed by a release of what its batches took."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The column `text`, or that field of a first column that holds whole rows."""
    return batch.column("text") if "text" in batch.schema.names else batch.column(0).field("text")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in order, cut so that a piece holds `limit` bytes of text at most, or one row."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(texts_of(batch)).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each word, and the words in order; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    return row[full.to_numpy(zero_copy_only=False)], words.filter(full)


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of strings."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes (arithmetic wraps)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (a >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted value in sorted `keys`, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def bucket_of(column: str, buckets: int) -> Column:
    """crc32 of a column's text modulo `buckets`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def seeded_sample(df: DataFrame, by: str, key: str, rows: int, seed: str) -> DataFrame:
    """About `rows` rows of each value of `by`, by a seeded hash of `key`: the same at every run.

    Groups of fewer rows are kept whole. The share comes from counts of all rows, which are
    written first, so that Spark knows their size and need not shuffle `df` to join them.
    """
    counts = Scratch(df.sparkSession, "sample").table(df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), "counts")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return df.join(counts, by).where(draw * F.col("_n") < rows).drop("_n")


def numbered(df: DataFrame, order: list[str | Column], scratch: Scratch, name: str, within: str | None = None) -> DataFrame:
    """The rows of `df` with `nth`, their place from 1 in the order, or in the order among rows of equal `within`.

    No task holds a whole table or a whole group: rows are dealt by ranges of the order, numbered in
    their range, and the numbers of earlier ranges are added. `within`, if given, must be what the
    order begins with. Equal rows are dealt apart by where they were read, so a row repeated any
    number of times fills no single range.
    """
    by = [*order, F.col("_dealt")]
    dealt = df.withColumn("_dealt", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_dealt").withColumn("_range", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            place = np.arange(1, batch.num_rows + 1, dtype=np.int64)
            if batch.num_rows and within:
                key = batch.column(within).to_numpy(zero_copy_only=False)
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
                place -= start
                if key[0] == last:
                    place[start == 0] += before
                last, before = key[-1], int(place[-1])
            elif batch.num_rows:
                place += before
                before = int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "_place"])

    schema = T.StructType([*ranged.schema.fields, T.StructField("_place", T.LongType())])
    written = scratch.table(ranged.mapInArrow(count, schema), name)
    keys = ["_range", *([within] if within else [])]
    sizes = written.groupBy(*keys).agg(F.max("_place").alias("_size"))
    earlier = Window.partitionBy(*([within] if within else [])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.sum("_size").over(earlier)).where("_before > 0").select(*keys, "_before")
    before = scratch.table(before, f"{name}-before")  # a row for each range at most
    placed = written.join(before, keys, "left").withColumn("nth", F.col("_place") + F.coalesce("_before", F.lit(0)))
    return placed.select(*df.columns, "nth")
