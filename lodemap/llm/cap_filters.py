"""Embedding near-duplicates by spherical-cap filters.

A vector is cut, after a seeded rotation, into PARTS parts, and every part has its own small random
code; a filter direction is one word of each code, so a few words make a great many directions.
A vector passes the filters whose direction it exceeds by ALPHA, found by decoding: sums of the
first half's words against sorted sums of the second half's. Vectors of one label that share a
filter are compared exactly. Close vectors share some of their filters almost surely, others hardly
ever. The higher ALPHA, the more filters a vector passes, so that vectors at the threshold share
no fewer. Filters are as many, and ALPHA as high, as the largest label needs for buckets of about LOAD.

Equal vectors are compared once. A bucket of any size is cut into blocks whose pairs are separate
groups. Links are never rows: a group adds up its links, each at the first filter that a pair
shares, and hands on which component every vector has there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodemap.llm.rotated_codes import usable
from lodemap.operators.graph import components
from lodemap.scratch import Scratch

PARTS = 2
#: Filters that a vector is expected to pass when a cap holds WIDEST of all vectors, and the fewest: below
#: it, its best ones are taken. Both grow as caps get smaller.
PASSED, FEWEST, WIDEST = 30, 20, 0.02
#: Vectors of a label in a bucket, about; rows of a block of a larger bucket.
LOAD, BLOCK = 24, 512
SEED = 11


def both(share: float, cosine: float) -> float:
    """Chance that a vector at `cosine` of one in a cap that holds `share` of all vectors is in it too."""
    alpha = NormalDist().inv_cdf(1 - share)
    x = np.linspace(alpha, alpha + 12, 6001)
    density = np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    inner = [1 - NormalDist().cdf((alpha - cosine * v) / np.sqrt(max(1e-12, 1 - cosine * cosine))) for v in x]
    return float(np.trapezoid(density * inner, x) / share)


class Filters:
    """Codes for `dimension` axes when a cap holds `share` of all vectors; vectors at cosine `least` share no fewer filters in small caps."""

    def __init__(self, dimension: int, share: float, least: float = 0.93):
        # squared, as the number shared also varies more from pair to pair in small caps
        more = (both(WIDEST, least) / both(share, least)) ** 2
        self.passed, self.fewest = PASSED * more, round(FEWEST * more)
        self.words = max(2, round((self.passed / share) ** (1 / PARTS)))
        self.alpha = NormalDist().inv_cdf(1 - share)
        rng = np.random.default_rng(SEED)
        self.turn = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
        self.cuts = np.linspace(0, dimension, PARTS + 1).astype(int)
        self.codes = [rng.standard_normal((self.words, b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        # words as long as their part's share of a unit direction
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(c.shape[1]) for c in self.codes]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filters that each unit vector passes."""
        turned, w = unit @ self.turn, self.words
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes)]
        half = PARTS // 2
        first, second = scores[0], scores[half]
        for s in scores[1:half]:
            first = (first[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
        for s in scores[half + 1 :]:
            second = (second[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(-second, axis=1)
        out, size = [], second.shape[1]
        for a, b, at in zip(first, second, order):
            ranked, alpha = -b[at], self.alpha
            n = np.searchsorted(ranked, a - alpha, side="right")
            while n.sum() < min(self.fewest, size * len(a)):
                alpha -= 0.1
                n = np.searchsorted(ranked, a - alpha, side="right")
            passed = np.repeat(np.arange(len(a)), n)
            inner = np.arange(len(passed)) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.sort(passed * size + at[inner]))
        return out


@lru_cache(8)
def filters(dimension: int, share: float, least: float) -> Filters:
    return Filters(dimension, share, least)


def group_links(ids: np.ndarray, unit: np.ndarray, copies: np.ndarray, side: np.ndarray | None, bucket: int, passed: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a group that are counted here, and its component's smallest id.

    `side` splits the rows of two blocks, between which alone pairs are counted; None: all pairs.
    """
    near = unit @ unit.T >= least - 1e-9
    for i, j in zip(*np.nonzero(np.triu(near & (np.abs(unit @ unit.T - least) < 1e-9), 1))):
        near[i, j] = near[j, i] = (unit[i] * unit[j]).sum() >= least
    np.fill_diagonal(near, False)
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], root.max(initial=0)).min(1, initial=np.iinfo(np.int64).max)) if len(ids) else root
        if (low == root).all():
            break
        root = low
    rows = np.flatnonzero(near.any(1))
    count = np.zeros(len(ids), np.int64)
    if len(rows):
        earlier = [p[p < bucket] for p in (passed[i] for i in rows)]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        seen = np.zeros((len(rows), len(names) or 1), np.float32)
        seen[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), at] = 1
        here = near[np.ix_(rows, rows)] & (seen @ seen.T == 0)
        if side is not None:
            here &= side[rows][:, None] != side[rows][None, :]
        count[rows] = here @ copies[rows]
    return count, root


def near_duplicates(vectors: DataFrame, least: float = 0.93, ident: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """`ident`, n_links, component_id, kept for every row of `vectors`.

    Rows of equal, non-null labels link when their cosine is at least `least`. Vectors that are
    null, zero, or hold null or non-finite components, and rows with null ids or labels, link with
    nothing: no links, and a component of their own. Vectors meet others of their length only.
    Repeated rows are vectors of their own, which link. Components may be of any numeric type and are
    compared in double precision. Other columns are not read.

    A pair is found when its vectors share a filter. In simulation (64 dimensions, up to 1.5 million
    vectors a label) 1 of 10,000 pairs exactly at 0.93 shared none; nothing finds a missed link afterwards.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    able = usable(column) & F.col(label).isNotNull() & F.col(ident).isNotNull()
    prints = [F.when(able, F.xxhash64(F.lit(s), F.col(label).cast("string"), F.col(column))).alias(f"h{s}") for s in (1, 2)]
    marked = scratch.table(vectors.select(F.col(ident).alias("id"), F.col(label).alias("label"), *prints), "marks")
    kinds = vectors.where(able).select(F.col(ident).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(column).alias("v"), *prints)
    kinds = kinds.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    kinds = scratch.table(kinds.withColumn("d", F.size("v")), "kinds")
    placement = f"label string, d int, bucket long, rep long, copies long, v {kinds.schema['v'].dataType.simpleString()}"
    most = kinds.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    share = min(WIDEST, LOAD / most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                size = part.column("d").to_numpy()
                for d in np.unique(size):
                    rows = part.filter(pa.array(size == d))
                    unit = _unit(rows.column("v"), int(d))
                    passed = filters(int(d), share, least).decode(unit)
                    n = [len(p) for p in passed]
                    at = pa.array(np.repeat(np.arange(len(n)), n))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(c).take(at) for c in ("label", "d")] + [pa.array(np.concatenate(passed))] + [rows.column(c).take(at) for c in ("rep", "copies", "v")],
                        ["label", "d", "bucket", "rep", "copies", "v"])

    placed = kinds.select("label", "d", "rep", "copies", "v").mapInArrow(place, placement)
    key = ["label", "d", "bucket"]
    slim = kinds.select("label", "d", "rep", "copies", "v").mapInArrow(place, placement).select(*key)
    large = scratch.table(slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "large")
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = (placed.join(large, key, "left").withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    group = [*key, "i", "j"]
    dealt = dealt.select(*group, "own", "rep", "copies", "v").repartition(*group).sortWithinPartitions(*group)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, group):
            d, i, j = (rows.column(c)[0].as_py() for c in ("d", "i", "j"))
            if rows.num_rows < 2:
                continue
            unit = _unit(rows.column("v").combine_chunks(), d)
            ids, copies, side = (rows.column(c).to_numpy() for c in ("rep", "copies", "own"))
            close = unit @ unit.T
            np.fill_diagonal(close, 0)
            near = np.flatnonzero(close.max(1) >= least - 1e-9)
            if not len(near):
                continue
            unit, ids, copies, side = unit[near], ids[near], copies[near], side[near]
            bucket = rows.column("bucket")[0].as_py()
            count, root = group_links(ids, unit, copies, side if i != j else None, bucket, filters(d, share, least).decode(unit), least)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(root)], ["rep", "n", "root"])

    found = scratch.table(dealt.mapInArrow(link, "rep long, n long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct()
    roots = components(kinds.select(F.col("rep").alias("node")), edges)
    whole = kinds.select("h1", "h2", "rep", "copies").join(roots, F.col("rep") == F.col("node")).join(links, "rep", "left")
    whole = scratch.table(whole.select("h1", "h2", "comp", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "whole")
    out = marked.join(whole, ["h1", "h2"], "left").select(
        F.col("id").alias(ident), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("comp", F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(ident) == F.col("component_id"), F.lit(True)))


def _unit(vectors: pa.Array, d: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in key:
            column = batch.column(c)
            codes = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(np.concatenate([[0], starts]), np.concatenate([starts, [batch.num_rows]])):
            piece = batch.slice(a, b - a)
            now = tuple(piece.column(c)[0].as_py() for c in key)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held, last = held + [piece], now
    if held:
        yield pa.Table.from_batches(held)
