"""Near copies by MinHash, and the linking of groups of any size."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from lodemap.operators import linking as L, near as N
from lodemap.scratch import Scratch

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     *[T.StructField(c, T.StringType()) for c in ("node", "keys", "id", "comp", "n")]])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], DOCS)


def slow_set(text, words=5):
    toks = [t.lower() for t in re.findall(r"[^\W\d_]+", text or "")]
    return frozenset(tuple(toks[i : i + words]) for i in range(len(toks) - words + 1)) if len(toks) >= words else frozenset([tuple(toks)] if toks else [])


def slow_groups(rows, least=80):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= least * len(a | b):
            links += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(rnd, n):
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 90)))) for i in range(n)]
    for i in range(n, 2 * n):  # copies with some words changed, clearly above or below the threshold
        words = rows[rnd.randrange(n)][1].split()
        for _ in range(rnd.choice([0, 1, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows


def test_dedup_near_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = corpus(rnd, 120)
    rows += [(900, None), (901, ""), (902, " 12 ,"), (903, "one two"), (904, "One, TWO"), (905, "x " * 4000), (906, "x " * 4100), (907, "long " * 50_000),
             (None, rows[0][1]), (None, None), (3, rows[3][1]), (3, "another text of the same key altogether here")]
    found = N.dedup_near(docs_of(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "group_id"]
    assert sorted(map(tuple, found.collect()), key=str) == slow_groups(rows)
    kept = N.keep_one(docs_of(spark, rows), found)
    assert kept.columns == DOCS.fieldNames() and kept.where("doc_id IS NULL").count() == 2
    assert N.dedup_near(docs_of(spark, [])).count() == 0


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of sets with 80 of 100 shingles in common: nearly all share a band."""
    rnd = random.Random(4)
    sets = []
    for _ in range(300):
        own = [rnd.getrandbits(63) for _ in range(100)]
        sets += [sorted(own[:90]), sorted(own[10:])]
    sig = np.stack([N.signature(np.array(keys, np.uint64)) for keys in sets])
    bands = np.stack([N.band_keys(row) for row in sig])
    met = (bands[::2] == bands[1::2]).any(1).sum()
    assert met >= 0.98 * 300
    agree = (sig[::2] == sig[1::2]).mean()
    assert agree == pytest.approx(0.8, abs=0.02)  # minima agree as often as the Jaccard similarity


def pairs_checked(spark, monkeypatch, n):
    rnd = random.Random(6)
    vocab = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)]
    base = [rnd.choice(vocab) for _ in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(200), 2):
            words[at] = f"changed{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000]}"
        rows.append((i, " ".join(words)))
    counted, table = [], Scratch.table

    def watch(self, df, name):
        out = table(self, df, name)
        if name.startswith("star-pairs") or name == "rest":
            counted.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", watch)
    groups = N.dedup_near(docs_of(spark, rows)).select("group_id").distinct().count()
    monkeypatch.setattr(Scratch, "table", table)
    return groups, sum(counted)


def test_pairs_of_one_large_group_grow_in_proportion(spark, monkeypatch):
    """Documents that are all near copies of one: the pairs checked follow their number, not its square."""
    few, many = pairs_checked(spark, monkeypatch, 300), pairs_checked(spark, monkeypatch, 900)
    assert few[0] == many[0] == 1
    assert many[1] < 20_000 and many[1] < 4.5 * few[1]


def test_rounds_and_blocks_find_every_link_of_a_group(spark, monkeypatch):
    """One group in which only neighbours on a line link: what rounds leave is found in blocks."""
    monkeypatch.setattr(L, "SLOW", 0.3)
    n = 700
    members = Scratch(spark, "test").table(spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node")), "members")

    def linked(pairs, name):
        return Scratch(spark, "test").table(pairs.where("dst - src <= 1"), name)

    comps, links, left = L.star_rounds(members, linked, Scratch(spark, "test"))
    assert left is not None
    close = lambda a, b: (abs(a.column("node").to_numpy()[:, None] - b.column("node").to_numpy()[None, :]) <= 1).nonzero()
    found = {tuple(r) for r in L.across(left, [], close, "long").collect()}
    comp = dict(map(tuple, comps.collect()))
    want = {(i, i + 1) for i in range(n - 1) if comp[i] != comp[i + 1]}
    assert want == found


def test_blocks_join_what_members_hold_once(spark):
    """Outsiders and members of all blocks come from one join, and a group of one block has each member once."""
    scratch = Scratch(spark, "test")
    left = scratch.table(spark.range(40).selectExpr("7L AS key", "id AS node", "CASE WHEN id < 10 THEN 0L ELSE id END AS comp", "0L AS main"), "left")
    held = scratch.table(spark.range(40).selectExpr("id AS node", "id * 3 AS x"), "held")
    close = lambda a, b: (abs(a.column("x").to_numpy()[:, None] - b.column("x").to_numpy()[None, :]) <= 3).nonzero()
    pairs = L.across(left, ["x"], close, "long", held)
    assert {tuple(r) for r in pairs.collect()} == {(i, i + 1) for i in range(9, 39)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*x#", plan)) == 1


def test_pairs_of_sizes_that_cannot_link_are_not_made(spark):
    members = Scratch(spark, "test").table(spark.range(60).selectExpr("7L AS key", "id AS node", "CAST(1 + id AS int) AS n"), "members")
    made = []

    def linked(pairs, name):
        made.extend(map(tuple, pairs.collect()))
        return Scratch(spark, "test").table(pairs.where("false"), name)

    fits = lambda n, m: 100 * F.least(n, m) >= 85 * F.greatest(n, m)
    _, _, left = L.star_rounds(members, linked, Scratch(spark, "test"), None, fits)
    assert made and all(100 * (1 + i) >= 85 * (1 + j) for i, j in made)
    assert left.count() == 60 and "n" in left.columns


def test_signatures_are_the_least_hashes_and_their_bands_are_made_at_once():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 511, 512, 513, 3000)]
    draw = np.random.default_rng(N._SEED)
    factor, shift = (draw.integers(a, 1 << 63, N.BANDS * N.ROWS, dtype=np.uint64).tolist() for a in (1, 0))
    made = [N.signature(keys) for keys in sets]
    for keys, sig in zip(sets[:2], made):
        plain = [min(((int(k) ^ int(k) >> 31) * (2 * f % 2**64 | 1) + h) % 2**64 >> 32 for k in keys) for f, h in zip(factor, shift)]
        assert sig.tolist() == plain
    for keys, sig in zip(sets, made):
        assert (sig == np.minimum.reduce([N.signature(keys[i : i + 1]) for i in range(len(keys))])).all()
    assert (N.band_keys(np.array(made)) == [N.band_keys(sig) for sig in made]).all()
    assert N.band_keys(np.array(made)[:0]).shape == (0, N.BANDS)
