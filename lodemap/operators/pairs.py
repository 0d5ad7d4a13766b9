"""Counting concept pairs without ever writing the pairs of one unit as rows.

The count of (a, b) over units is a product of two unit-by-concept 0/1 matrices. Each task
adds its own units into one small dense block of that product and emits the non-zero cells,
so a unit with many concepts costs arithmetic, not rows. Spark splits the units, and sums
the blocks of all tasks in one shuffle of at most (tasks x vocabulary^2) short rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 4096  # concepts per side of a block: a task holds one block of int32 counts, 64 MB at most

_OUT = T.StructType([
    T.StructField("grp", T.IntegerType()),
    T.StructField("a", T.IntegerType()),
    T.StructField("b", T.IntegerType()),
    T.StructField("n", T.LongType()),
])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _add(acc: np.ndarray, lo, lv, ro, rv) -> None:
    """Add every unit's (left, right) pairs into the count matrix."""
    ll, rl = np.diff(lo), np.diff(ro)
    wl, wr = acc.shape
    todo = np.concatenate([[0], np.cumsum(ll.astype(np.int64) * rl)])
    start = 0
    while start < len(ll):
        # As many units as give some millions of pairs, but at least one and at most 1,024.
        stop = max(start + 1, int(np.searchsorted(todo, todo[start] + 4_000_000, side="right")) - 1)
        stop = min(stop, start + 1024, len(ll))
        pairs = todo[stop] - todo[start]
        left, right = lv[lo[start]:lo[stop]], rv[ro[start]:ro[stop]]
        n_l, n_r = ll[start:stop], rl[start:stop]
        if pairs * 1e-8 > 2.0 * (stop - start) * wl * wr / 3e10:
            x = np.zeros((stop - start, wl), np.float32)
            y = np.zeros((stop - start, wr), np.float32)
            x[np.repeat(np.arange(stop - start), n_l), left] = 1
            y[np.repeat(np.arange(stop - start), n_r), right] = 1
            acc += (x.T @ y).astype(np.int32)
        elif pairs:
            width = np.repeat(n_r, n_l)
            first = np.repeat(ro[start:stop] - ro[start], n_l)
            ends = np.cumsum(width)
            at = np.arange(ends[-1]) - np.repeat(ends - width, width) + np.repeat(first, width)
            cells = np.repeat(left.astype(np.int64), width) * wr + right[at]
            np.add.at(acc.reshape(-1), cells, np.int32(1))
        start = stop


def _counter(width: int, upper: bool):
    def emit(acc, key) -> Iterator[pa.RecordBatch]:
        grp, bl, br = key
        i, j = np.nonzero(acc)
        n = acc[i, j].astype(np.int64)
        a, b = i + bl * WIDTH, j + br * WIDTH
        if upper:
            keep = a < b
            a, b, n = a[keep], b[keep], n[keep]
        for s in range(0, len(n), 200_000):
            part = slice(s, s + 200_000)
            yield pa.record_batch(
                [np.full(len(n[part]), grp, np.int32), a[part].astype(np.int32), b[part].astype(np.int32), n[part]],
                names=["grp", "a", "b", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = min(width, WIDTH)
        acc, current = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                key = tuple(int(x) for x in keys[lo])
                if key != current:
                    if current is not None:
                        yield from emit(acc, current)
                    acc, current = np.zeros((side, side), np.int32), key
                l_off, l_val = _lists(batch.column(3).slice(lo, hi - lo))
                r_off, r_val = _lists(batch.column(4).slice(lo, hi - lo))
                _add(acc, l_off, l_val - key[1] * WIDTH, r_off, r_val - key[2] * WIDTH)
        if current is not None:
            yield from emit(acc, current)

    return run


def _by_block(ids: str) -> Column:
    """The ids of a row parted by block: array of (block, ids)."""
    def block(x: Column) -> Column:
        return F.floor(x / WIDTH).cast("int")

    return F.transform(
        F.array_distinct(F.transform(ids, block)),
        lambda b: F.struct(b.alias("block"), F.filter(ids, lambda x: block(x) == b).alias("ids")),
    )


def pair_counts(rows: DataFrame, width: int, upper: bool = False, by: str | None = None) -> DataFrame:
    """(grp, a, b, n): in how many rows id a is in `l` and id b in `r`.

    `rows` has array<int> columns `l` and `r` of distinct ids below `width`, and an int
    group column when `by` is given. A vocabulary wider than one block is cut into blocks: a
    row's ids are parted by block once, it then stands once per pair of blocks it has ids in,
    and each task sorts its rows by block pair so that it holds one block of counts at a time.
    `upper` keeps a < b, for symmetric input.
    """
    blocks = -(-width // WIDTH)
    grp = F.col(by).cast("int") if by else F.lit(0)
    cells = rows.select(grp.alias("grp"), "l", "r")
    if blocks == 1:
        cells = cells.select("grp", F.lit(0).alias("bl"), F.lit(0).alias("br"), "l", "r")
    else:
        cells = cells.select("grp", F.explode(_by_block("l")).alias("p"), _by_block("r").alias("r"))
        cells = cells.select("grp", "p", F.explode("r").alias("q"))
        if upper:
            cells = cells.where("q.block >= p.block")
        cells = cells.select(
            "grp", F.col("p.block").alias("bl"), F.col("q.block").alias("br"), F.col("p.ids").alias("l"), F.col("q.ids").alias("r")
        )
    cells = cells.where((F.size("l") > 0) & (F.size("r") > 0))
    if blocks > 1 or by:
        cells = cells.sortWithinPartitions("grp", "bl", "br")
    return (
        cells.mapInArrow(_counter(width, upper), _OUT)
        .groupBy("grp", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
