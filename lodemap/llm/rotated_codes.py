"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector is rotated by one seeded random rotation and kept as BITS bits for each dimension with
two scalars, its norm and how well the bits align with it. From a query's rotated values and these
the inner product is estimated without bias, and an error bound comes with every estimate. In a
block of candidates only vectors whose upper bound reaches the k-th best lower bound are compared
exactly, in double precision. The k best of every block meet in one ranking per query.

Queries meet candidates block by block: a block of candidates goes to as many tasks as there are
blocks of queries, and no pair but the k best of a query and block ever becomes a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from lodemap.scratch import Scratch

#: Width of the error bound in standard errors.
EPSILON = 2.5
#: Bits of a code for each dimension: vectors are padded with zeros before the rotation.
BITS = 4
#: Rows of a block of queries and of candidates, about.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
SEED = 7


@lru_cache(8)
def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """What a random rotation of BITS * `dimension` axes does to vectors padded with zeros."""
    bits = BITS * dimension
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, norms, and alignments of the unit vectors with their bits."""
    turned = vectors @ rotation(vectors.shape[1])
    norm = np.linalg.norm(turned, axis=1)
    aligned = np.abs(turned).sum(1) / (np.sqrt(turned.shape[1]) * norm)
    return np.packbits(turned > 0, axis=1), norm, aligned


def estimate(codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and the half width of their bounds."""
    turned = (queries @ rotation(queries.shape[1])).astype(np.float32)
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    scale = (norm / (aligned * np.sqrt(d))).astype(np.float32)
    spread = norm * np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned * EPSILON / np.sqrt(max(d - 1, 1))
    return turned @ signs.T * scale, np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * spread.astype(np.float32)


def usable(column: str) -> Column:
    """Whether a vector is there, not zero, and free of null, NaN and infinite components."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _best(query: np.ndarray, at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: by score, ties to the smaller id."""
    order = np.lexsort((ids[at], -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, code: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, exact score) of the k best of the block for each query."""
    found = []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        about, half = estimate(*code, part)
        own = query_ids[start : start + 256, None] == ids[None, :]
        low = np.where(own, -np.inf, about - half)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
        query, at = np.nonzero((about + half >= least[:, None]) & ~own)
        score = np.empty(len(query))
        for a in range(0, len(query), 1 << 17):
            some = slice(a, a + (1 << 17))
            score[some] = (vectors[at[some]] * part[query[some]]).sum(1)
        best = _best(query, at, ids, score, k)
        found.append((query[best] + start, at[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest inner product but its own.

    Vectors that are null, zero, or hold null or non-finite components take no part, and vectors
    meet others of their length only. Fewer than k candidates: all of them. Equal scores go to the
    smaller id. Rows with one id are one query each and no candidates of each other.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = vectors.where(usable(column) & F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v"), is_query.alias("query"))
    rows = scratch.table(rows.withColumn("d", F.size("v")), "vectors")
    sizes = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("q")).collect()}
    n, q = max((a for a, _ in sizes.values()), default=0), max((b for _, b in sizes.values()), default=0)
    across, down = max(1, -(-q // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    place = lambda blocks, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(blocks)).cast("int")
    asked = rows.where("query").select("id", "v", "d", place(across, "q").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"))
    given = rows.select("id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), place(down, "c").alias("j"))

    def meet(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(given):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = np.stack(asked["v"].to_numpy()), np.stack(given["v"].to_numpy())
        ids, query_ids = given["id"].to_numpy(), asked["id"].to_numpy()
        query, at, score = search_block(a, query_ids, b, ids, encode(b), k)
        return pd.DataFrame({"query_id": query_ids[query], "vec_id": ids[at], "score": score})

    key = ["d", "i", "j"]
    found = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
