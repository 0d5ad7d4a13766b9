"""Rotated codes and cap filters against brute force."""

import math

import numpy as np
import pytest

from lodemap.llm import cap_filters as C, queries, rotated_codes as R

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", None, 1) for i, v, lab in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x for x in v)


def nearest(rows, asks, k):
    out = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and asks(i):
            others = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), j) for j, w, _ in rows if j != i and usable(w) and len(w) == len(v)]
            out[i] = sorted(others)[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(300 + i, [float(x) for x in base[7]], 1) for i in range(90)]  # a third are copies of one
    rows += [(400 + i, [float(x) for x in base[8] + 0.05 * rng.standard_normal(16)], 2) for i in range(80)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    rows += [(500 + 20 * i, v, 1) for i, v in enumerate(odd)]
    return rows + [(900, [float(x) for x in base[7]], None)]


def test_op2_exact_scores_and_recall(spark, vectors):
    got = {}
    for r in R.nearest(frame(spark, vectors), R.F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = nearest(vectors, lambda i: i % 20 == 0, 7)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(best) + 1))
        exact = {j: -s for s, j in nearest(vectors, lambda i: i == q, len(vectors))[q]}
        assert all(abs(exact[j] - s) < 1e-9 for _, j, s in got[q])
        hits += len({j for _, j in best} & {j for _, j, _ in got[q]})
        total += len(best)
    assert hits >= 0.98 * total


def test_op2_copies_rank_by_id_and_blocks_do_not_matter(spark, vectors, monkeypatch):
    ask = R.F.col("vec_id").isin(7, 300, 520)
    one = R.nearest(frame(spark, vectors), ask, k=20).orderBy("query_id", "rank").collect()
    ids = [r.vec_id for r in one if r.query_id == 7]
    assert ids == list(range(300, 320))
    monkeypatch.setattr(R, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert R.nearest(frame(spark, vectors), ask, k=20).orderBy("query_id", "rank").collect() == one


def test_op2_empty(spark):
    assert R.nearest(frame(spark, []), R.F.col("vec_id") % 20 == 0).count() == 0


def test_op2_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    about, half = R.estimate(*R.encode(v), q)
    assert (np.abs(about - q @ v.T) <= half).mean() > 0.97


def test_op2_recall_on_the_table(spark, folder):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = nearest(rows, lambda i: i % 20 == 0, 20)
    got = queries.QUERIES["op2_rotated_codes"](spark, folder).collect()
    assert len(got) == 20 * len(want)
    assert sum(r.vec_id in {j for _, j in want[r.query_id]} for r in got) >= 0.95 * len(got)


def links(rows, least=0.93):
    """n_links and component by comparing all."""
    unit = {}
    for at, (i, v, lab) in enumerate(rows):
        if usable(v) and lab is not None and i is not None:
            x = np.float64(np.float32(v))
            unit[at] = x / np.sqrt((x * x).sum())
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float((unit[a] * unit[b]).sum()) >= least:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = sorted((find(a), find(b)), key=lambda c: rows[c][0])
                root[y] = x
    return sorted((r[0], n[at], rows[find(at)][0], r[0] == rows[find(at)][0]) for at, r in enumerate(rows))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_op9_links_copies_and_near_copies(spark, vectors):
    assert got(C.near_duplicates(frame(spark, vectors))) == links(vectors)


def test_op9_large_buckets_are_cut(spark, vectors, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    assert got(C.near_duplicates(frame(spark, vectors))) == links(vectors)


def test_op9_double_components_keep_their_precision(spark):
    """Two pairs on either side of the threshold, by less than single precision tells."""
    rows = []
    for i, cosine in enumerate((0.93 + 1e-9, 0.93 - 1e-9)):
        u, w = np.eye(8)[2 * i], np.eye(8)[2 * i + 1]
        rows += [(10 * i, u.tolist(), 1), (10 * i + 1, (cosine * u + math.sqrt(1 - cosine**2) * w).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(C.near_duplicates(df)) == [(0, 1, 0, True), (1, 1, 0, False), (10, 0, 10, True), (11, 0, 11, True)]


def test_op9_null_ids_and_empty(spark, vectors):
    assert C.near_duplicates(frame(spark, [])).count() == 0
    row = C.near_duplicates(frame(spark, vectors[:5] + [(None, vectors[0][1], 0)])).where("vec_id IS NULL").first()
    assert (row.n_links, row.component_id) == (0, None)


def test_op9_pairs_at_the_threshold_share_filters_of_large_labels():
    rng = np.random.default_rng(3)
    f = C.filters(64, C.LOAD / 300_000, 0.93)
    missed = 0
    for _ in range(5):
        u, w = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, 1000, 64)))
        w -= (w * u).sum(1)[:, None] * u
        v = 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1)[:, None]
        missed += sum(not len(np.intersect1d(a, b)) for a, b in zip(f.decode(u), f.decode(v)))
    assert missed <= 2


def test_op9_close_pairs_share_filters():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for share in (0.02, 0.002):
        f = C.Filters(64, share)
        shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(f.decode(a), f.decode(b))]
        assert np.mean(shared) > 0.98, share


def test_op9_whole_table(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op9_cap_filters"](spark, folder)) == links(rows)
