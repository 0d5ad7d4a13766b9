"""Near copies of documents by MinHash.

A document's set is its distinct shingles of words. Equal sets are one node. Each node has a signature of
BANDS x ROWS minima, and nodes that agree in one band are candidates; their groups are linked without
expanding them into pairs (see `linking`), and every link is verified by the Jaccard similarity of the
sets themselves. Only nodes in a group of at least two have their sets built a second time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lodemap.functions import text as tx
from lodemap.operators.graph import components
from lodemap.operators.linking import across, star_rounds
from lodemap.scratch import Scratch

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle, and the least similarity of linked documents in hundredths.
WORDS, LEAST = 5, 80
#: Two sets at the threshold share a band with probability 1 - (1 - 0.8**5)**16 = 0.998.
BANDS, ROWS = 16, 5
#: Standard errors by which a signature may fall short of the threshold before a pair in a block is passed over.
DOUBT = 4.0
_SEED = 20


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """64 bits that stand for ordered pairs (arithmetic wraps)."""
    x = (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_sets(toks: pa.ListArray, words: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed runs of `words` words of each row; a shorter row as one, none without words."""
    row = pc.list_parent_indices(toks).to_numpy()
    coded = toks.flatten().dictionary_encode()
    names = pd.util.hash_array(np.array(coded.dictionary.to_pylist() or [""], object), categorize=False)
    word = names[coded.indices.to_numpy()].astype(np.uint64)
    run = word
    for k in range(1, words):
        run = _mix(run[: len(word) - k], word[k:]) if len(word) > k else run[:0]
    ends = np.searchsorted(row, np.arange(len(toks)), side="right")
    start = 0
    for end in ends:
        if end - start >= words:
            own = np.sort(run[start : end - words + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif end > start:
            short = word[start : start + 1]
            for k in range(start + 1, end):
                short = _mix(short, word[k : k + 1])
            yield _mix(short, np.uint64(end - start))
        else:
            yield np.zeros(0, np.uint64)
        start = end


def _name(keys: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return np.array([_mix(keys, np.uint64(seed)).sum(dtype=np.uint64) for seed in (1, 2)]).tobytes()


def _seeded() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the BANDS x ROWS multiplicative hashes."""
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return factor, rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


_FACTOR, _SHIFT = _seeded()
#: Shingles whose hashes are made at once: few enough that they stay in a core's cache.
_STEP = 512


def signature(keys: np.ndarray) -> np.ndarray:
    """BANDS x ROWS minima, 32 bits each, of a set: the highest bits of seeded multiplicative hashes."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(keys), _STEP):
        own = keys[s : s + _STEP]
        made = (own ^ own >> np.uint64(31))[:, None] * _FACTOR
        made += _SHIFT
        np.minimum(out, made.min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)  # the highest bits of the least are the least of the highest bits


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature, or of each of many."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in np.moveaxis(sig.reshape(*sig.shape[:-1], BANDS, ROWS), -1, 0):
        key = _mix(key, column.astype(np.uint64))
    return key


def pieces(batches: Iterator[pa.RecordBatch], tokens: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, cut so that a piece has at most `tokens` words, or one row."""
    for batch in batches:
        ends = np.cumsum(np.nan_to_num(pc.list_value_length(batch.column("toks")).to_numpy(zero_copy_only=False)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + tokens, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _agree(least: int):
    """Pairs of a block whose signatures leave the threshold possible."""
    p = least / 100
    enough = BANDS * ROWS * (p - DOUBT * np.sqrt(p * (1 - p) / (BANDS * ROWS)))

    def run(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1) for t in (a, b))
        same = np.zeros((len(x), len(y)), np.int16)
        for k in range(x.shape[1]):
            same += x[:, None, k] == y[None, :, k]
        return np.nonzero(same >= enough)

    return run


def dedup_near(docs: DataFrame, words: int = WORDS, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles, group_id: the smallest `key` that links reach, for every row of `docs`.

    Documents link when 100 * common >= `least` * united shingles, checked on the sets, if their
    signatures meet in a band: no wrong link, and 2 in 1,000 missed at the threshold itself, fewer
    above it. Texts without words, empty or null ones link with nothing; shorter texts than a
    shingle are one shingle. Equal texts link. A row with a null key has its count, links with nothing
    and has no group; rows with one key are rows of their own. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.schema[key].dataType.simpleString()
    # Words are found in the JVM; sets and signatures are made of them in numpy.
    units = docs.select(F.col(key).alias("id"), tx.words(text).alias("toks"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, node, made = [], [], []
            for named, keys in zip(batch.column("id").is_valid().to_pylist(), shingle_sets(batch.column("toks"), words)):
                n.append(len(keys))
                made.append(signature(keys) if named and len(keys) else None)
                node.append(None if made[-1] is None else _name(keys))
            keys = iter(band_keys(np.array([sig for sig in made if sig is not None], np.uint32).reshape(-1, BANDS * ROWS)).view(np.int64))
            bands = [None if sig is None else next(keys) for sig in made]
            sigs = [None if sig is None else sig.tobytes() for sig in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n", "node", "bands", "sig"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = list(shingle_sets(batch.column("toks"), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([_name(keys) for keys in made], pa.binary()), pa.array([keys.view(np.int64) for keys in made], pa.list_(pa.int64()))],
                ["node", "name", "keys"])

    marks = scratch.table(units.mapInArrow(mark, f"id {kind}, n int, node binary, bands array<long>, sig binary"), "marks")
    known = marks.where("node IS NOT NULL")
    reps = scratch.table(known.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "reps")
    entries = reps.select("node", F.explode("bands").alias("key"))
    shared = scratch.table(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared")
    members = scratch.table(entries.join(shared, "key").select("key", "node"), "members")
    meeting = members.select("node").distinct()
    holders = scratch.table(reps.join(meeting, "node", "left_semi").select("id", "node"), "holders")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(holders, "id")
    again = texts.select("node", tx.words("text").alias("toks")).mapInArrow(gather, "node binary, name binary, keys array<long>")
    again = scratch.table(again.where("node = name").groupBy("node").agg(F.first("keys").alias("keys")), "sets")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(again.select(F.col("node").alias("dst"), F.col("keys").alias("b")), "dst").join(
            again.select(F.col("node").alias("src"), F.col("keys").alias("a")), "src")
        common = F.size(F.array_intersect("a", "b"))
        return scratch.table(both.where(100 * common >= least * (F.size("a") + F.size("b") - common)).select("src", "dst"), name)

    comps, _, left = star_rounds(members, linked, scratch)
    if left is not None:
        sig = scratch.table(known.join(meeting, "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig")), "signatures")
        left = scratch.table(left, "left")
        last = linked(scratch.table(across(left, ["sig"], _agree(least), "binary", sig), "rest"), "rest-links")
        joined = comps.select(F.col("node").alias("src"), F.col("comp").alias("dst")).unionByName(last)
        comps = scratch.table(components(comps.select("node"), joined), "comps")
    placed = scratch.table(reps.select("id", "node").join(comps, "node", "left").select("id", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    roots = scratch.table(placed.groupBy("comp").agg(F.min("id").alias("group_id")), "roots")
    groups = scratch.table(placed.join(roots, "comp").select("node", "group_id"), "groups")
    return marks.select("id", "n", "node").join(groups, "node", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("group_id", "id").alias("group_id"))


def keep_one(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that name their group, by what `dedup_near` returns for `docs`; rows with a null key stay.

    Rows that repeat such a key all stay: `dedup_exact` takes care of those.
    """
    copies = groups.where(F.col("group_id") != F.col(key)).select(key).distinct()
    return docs.join(copies, key, "left_anti")
