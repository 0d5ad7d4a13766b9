from collections import Counter
from itertools import product

import numpy as np
import pytest

from lodemap.operators import pairs as P


def brute(rows, upper=False):
    out = Counter()
    for l, r in rows:
        for a, b in product(l, r):
            if not upper or a < b:
                out[a, b] += 1
    return out


def counted(df):
    return {(r["a"], r["b"]): r["n"] for r in df.collect()}


def make(seed, n, width, most):
    rng = np.random.default_rng(seed)
    pick = lambda: sorted(int(x) for x in rng.choice(width, rng.integers(0, most + 1), replace=False))
    return [(pick(), pick()) for _ in range(n)]


@pytest.mark.parametrize("width,most", [(7, 7), (60, 5), (60, 60), (9000, 30), (9000, 300)])
def test_equal_to_brute_force(spark, width, most):
    rows = make(width + most, 40, width, most)
    df = spark.createDataFrame(rows, "l array<int>, r array<int>").repartition(3)
    assert counted(P.pair_counts(df, width)) == brute(rows)


def test_upper_half_of_a_wide_vocabulary(spark):
    rows = [(l, l) for l, _ in make(5, 30, 9000, 200)]
    df = spark.createDataFrame(rows, "l array<int>, r array<int>").repartition(3)
    assert counted(P.pair_counts(df, 9000, upper=True)) == brute(rows, upper=True)


def test_groups_stay_apart(spark):
    rows = [(g, *x) for g in (1, 2, 3) for x in make(g, 20, 30, 6)]
    df = spark.createDataFrame(rows, "lag int, l array<int>, r array<int>").repartition(4)
    got = {(r["grp"], r["a"], r["b"]): r["n"] for r in P.pair_counts(df, 30, by="lag").collect()}
    want = {(g, a, b): n for g in (1, 2, 3) for (a, b), n in brute([r[1:] for r in rows if r[0] == g]).items()}
    assert got == want


def test_both_ways_of_adding_agree():
    rows = make(3, 50, 200, 150)

    def lists(i):
        flat = [np.array(r[i], np.int32) for r in rows]
        return np.concatenate([[0], np.cumsum([len(x) for x in flat])]), np.concatenate(flat)

    acc = np.zeros((200, 200), np.int32)
    P._add(acc, *lists(0), *lists(1))
    assert {(int(i), int(j)): int(acc[i, j]) for i, j in zip(*np.nonzero(acc))} == brute(rows)


def test_a_unit_with_every_concept_emits_no_pair_rows(spark):
    """One unit with all ids is one row in and one block of counts out."""
    width = 300
    df = spark.createDataFrame([(list(range(width)),) * 2] * 3, "l array<int>, r array<int>").coalesce(1)
    got = P.pair_counts(df, width, upper=True)
    assert got.count() == width * (width - 1) // 2
    assert {r["n"] for r in got.collect()} == {3}
