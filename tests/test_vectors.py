import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemap.scratch import Scratch
from lodemap.operators import cells, groups as E, vectors as V
from lodemap.sources.readers import clean_vectors


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "vec_id long, v array<double>")


def brute(m, k, ids=None):
    ids = list(range(len(m))) if ids is None else list(ids)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        near = sorted((-sim[i, j], b) for j, b in enumerate(ids) if j != i)[:k]
        out[a] = [(b, -s) for s, b in near]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["src"], r["rank"])):
        out.setdefault(r["src"], []).append((r["dst"], r["sim"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for a in want:
        assert [b for b, _ in got[a]] == [b for b, _ in want[a]], a
        assert np.allclose([s for _, s in got[a]], [s for _, s in want[a]], atol=2e-6)


@pytest.fixture(scope="module")
def random_vectors():
    return np.random.default_rng(3).normal(size=(120, 8))


@pytest.mark.parametrize("block_rows", [1000, 17])
def test_knn_equals_brute_force(spark, random_vectors, block_rows):
    same(lists(V.knn_exact(frame(spark, random_vectors), 4, block_rows)), brute(random_vectors, 4))


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_knn_with_a_third_of_copies(spark, random_vectors, block_rows):
    m = random_vectors[:60].copy()
    m[10:30] = m[5]        # 21 copies of one vector
    m[40] = m[41] = m[42]  # a kind smaller than k
    ids = np.random.default_rng(1).permutation(1000)[:60]
    same(lists(V.knn_exact(frame(spark, m, ids), 4, block_rows)), brute(m, 4, ids))


def test_strips_inside_a_block(spark, random_vectors, monkeypatch):
    monkeypatch.setattr(V, "STRIP", 7)
    same(lists(V.knn_exact(frame(spark, random_vectors), 4, 50)), brute(random_vectors, 4))
    few = {(r["src"], r["dst"]) for r in V.similar_pairs(frame(spark, random_vectors), 0.5, 50).collect()}
    monkeypatch.undo()
    assert few == {(r["src"], r["dst"]) for r in V.similar_pairs(frame(spark, random_vectors), 0.5).collect()}


def test_memory_of_a_task_does_not_follow_the_size_of_its_blocks(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(V, "_blocked", lambda vectors, blocks, keep, schema: keep)
    keep = V._knn(None, None, 5)
    rng, peaks = np.random.default_rng(0), []
    for n in (2048, 8192):
        blocks = [pd.DataFrame({"vec_id": np.arange(n) + s, "v": list(rng.normal(size=(n, 64)))}) for s in (0, n)]
        tracemalloc.start()
        found = keep(*blocks, False)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert len(found) == 2 * 5 * n
    # Vectors alone take 1 KB a row and block; 8192 x 8192 cosines would take 512 MB.
    assert peaks[1] < 60 and peaks[1] <= 4 * peaks[0]


def test_single_precision_decides_nothing(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1, 8)) + 1e-4 * rng.normal(size=(1300, 8))  # all cosines are 1 but for a few last digits
    same(lists(V.knn_exact(frame(spark, m), 5)), brute(m, 5))


def test_knn_fewer_vectors_than_k(spark):
    same(lists(V.knn_exact(frame(spark, np.eye(3)), 5)), brute(np.eye(3), 5))


def test_knn_approx_is_exact_with_all_cells_and_close_with_some(spark, random_vectors):
    vectors = frame(spark, random_vectors)
    same(lists(V.knn_approx(vectors, 4, probes=1000, leaf=16)), brute(random_vectors, 4))
    row = V.recall(V.knn_approx(vectors, 4, probes=5, leaf=16), V.knn_exact(vectors, 4)).first()
    assert row["n_exact"] == 480
    assert row["recall"] > 0.8


def clustered(n):
    """Vectors in `n` / 50 groups of 64 dimensions."""
    rng = np.random.default_rng(3)
    return rng.normal(size=(n // 50, 64)).repeat(50, 0) + 0.5 * rng.normal(size=(n, 64))


def test_products_per_vector_hardly_grow_with_the_table(spark):
    cost, found = {}, {}
    for n in (2000, 20_000):
        vectors = frame(spark, clustered(n))
        scratch = Scratch(spark, "test")
        index = cells.Index(vectors.select("vec_id", "v"), scratch)
        cost[n] = index.products(cells.PROBES) / n
        lying = index.members.groupBy("leaf").count().agg({"count": "max"}).first()[0]
        assert index.members.count() == n and lying < 20 * cells.LEAF
    m = clustered(20_000)
    near = V.knn_approx(frame(spark, m), 5).where("src < 400").toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u[:400] @ u.T
    sim[np.arange(400), np.arange(400)] = -np.inf
    best = np.argsort(-sim, axis=1)[:, :5]
    found = sum(len(set(g["dst"]) & set(best[i])) for i, g in near.groupby("src"))
    assert found >= 0.9 * 400 * 5
    assert cost[20_000] <= 2 * cost[2000] and cost[20_000] < 20_000 / 4


def test_knn_approx_finds_nine_of_ten_without_any_structure(spark):
    m = np.random.default_rng(9).normal(size=(5000, 32))
    vectors = frame(spark, m)
    exact = V.knn_exact(vectors, 5)
    assert V.recall(V.knn_approx(vectors, 5), exact).first()["recall"] >= 0.9


def test_probes_rise_where_the_given_ones_miss(spark):
    m = clustered(4000)
    vectors = frame(spark, m)
    scratch = Scratch(spark, "test")
    index = cells.Index(vectors.select("vec_id", "v"), scratch, leaf=8)
    exact = V.knn_exact(vectors, 5)
    needed = index.needed(exact.where("src % 10 = 0"), 0.9)
    few = index.compared(needed, lambda left, right: V._gathered(V._nearest(left, right, 5)), "src long, dst long, sim double")
    met = exact.where("src % 10 = 0").join(few.select("src", "dst").distinct(), ["src", "dst"]).count()
    assert needed >= 1 and met >= 0.9 * 2000


def test_cells_hold_a_crowd_of_near_copies_and_whole_copies(spark, random_vectors, monkeypatch):
    close = random_vectors.copy()
    close[:40] = close[0] + 1e-3 * random_vectors[:40]
    close[110:] = close[5]
    one = V.knn_approx(frame(spark, close), 4, leaf=8).orderBy("src", "rank").collect()
    monkeypatch.setattr(cells, "BLOCK", 7)
    cut = V.knn_approx(frame(spark, close), 4, leaf=8).orderBy("src", "rank").collect()
    assert one == cut and {r["src"] for r in one} == set(range(len(close)))


def test_approx_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>, label int")
    assert V.knn_approx(none, 3).count() == 0 and V.similar_pairs_approx(none, 0.5).count() == 0


def test_similar_pairs_link_copies_as_a_star(spark):
    m = np.array([[1, 0], [1, 0], [1, 0], [0.9, 0.1], [0, 1]], float)
    got = {(r["src"], r["dst"]): r["kind"] for r in V.similar_pairs(frame(spark, m), 0.95, block_rows=2).collect()}
    assert got == {(0, 3): "similar", (0, 1): "copy", (0, 2): "copy"}


def test_similar_pairs_equal_brute_force_over_blocks(spark, random_vectors):
    u = random_vectors / np.linalg.norm(random_vectors, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sim[i, j] >= 0.5}
    got = {(r["src"], r["dst"]) for r in V.similar_pairs(frame(spark, random_vectors), 0.5, block_rows=13).collect()}
    assert got == want


def test_similar_pairs_approx_has_no_wrong_pair(spark, random_vectors):
    vectors = frame(spark, random_vectors)
    exact = {(r["src"], r["dst"], r["sim"]) for r in V.similar_pairs(vectors, 0.4).collect()}
    one = {(r["src"], r["dst"], r["sim"]) for r in V.similar_pairs_approx(vectors, 0.4, probes=1000, leaf=16).collect()}
    some = {(r["src"], r["dst"], r["sim"]) for r in V.similar_pairs_approx(vectors, 0.4, probes=5, leaf=16).collect()}
    assert one == exact
    assert some <= exact and len(some) > 0.8 * len(exact)


def test_mutual(spark):
    knn = spark.createDataFrame([(1, 2, 0.9, 1), (2, 1, 0.9, 1), (3, 1, 0.5, 1)], "src long, dst long, sim double, rank int")
    assert [tuple(r) for r in V.mutual(knn).collect()] == [(1, 2, 0.9)]


def test_unusable_vectors_are_dropped(spark):
    raw = spark.createDataFrame(
        [(1, [1.0, 2.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [1.0, None], 0)],
        "vec_id long, embedding array<float>, label int",
    )
    assert [r["vec_id"] for r in clean_vectors(raw).collect()] == [1]


def test_profile_medoid(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.8, 0.2], "a"), (3, [0.0, 1.0], "a"), (4, [0.0, 2.0], "b")]
    got = {r["cluster"]: r for r in E.cluster_profile(spark.createDataFrame(rows, "vec_id long, v array<double>, cluster string")).collect()}
    assert (got["a"]["size"], got["a"]["medoid"]) == (3, 2)
    assert (got["b"]["medoid"], got["b"]["medoid_sim"], got["b"]["centroid_norm"]) == (4, 1.0, 2.0)


def test_two_tight_groups_are_found_and_seeded(spark):
    rng = np.random.default_rng(0)
    m = np.vstack([rng.normal((5, 0), 0.1, (20, 2)), rng.normal((0, 5), 0.1, (20, 2))])
    vectors = frame(spark, m)
    for build in (E.kmeans, E.hierarchy):
        one = {r["vec_id"]: r["cluster"] for r in build(vectors, 2, seed=3).collect()}
        assert len({one[i] for i in range(20)}) == len({one[i] for i in range(20, 40)}) == 1
        assert one[0] != one[39]
        assert one == {r["vec_id"]: r["cluster"] for r in build(vectors, 2, seed=3).collect()}


def test_agreement_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "a int, b int")
    row = E.agreement(df, "a", "b").first()
    # Of six pairs, (1,2) is together in both; three are apart in both or together in both.
    assert (row["n"], row["purity"], row["rand"]) == (4, 0.75, 0.5)


def test_topics_shape(spark, folder):
    from lodemap.operators.concepts import token_units
    from lodemap.sources import read_turns

    units = token_units(read_turns(spark, folder), "conv_id", "turn")
    out = E.topics(units, k=3, rounds=2, n_terms=4)
    assert out.count() == 12
    assert out.where((F.col("weight") <= 0) | F.col("concept").isNull()).count() == 0


def test_topics_keep_no_tokens_to_choose_terms(spark, monkeypatch):
    """Terms of 2 units up to half of them, by a count: a share made CountVectorizer hold all tokens of a partition."""
    made, fit = [], E.CountVectorizer.fit
    monkeypatch.setattr(E.CountVectorizer, "fit", lambda self, data: made.append((self.getMaxDF(), fit(self, data))) or made[-1][1])
    units = [(i, ["all", f"own{i}", "half" if i % 2 else "other", *["few"] * (i < 2), *["most"] * (i < 4)]) for i in range(6)]
    E.topics(spark.createDataFrame(units, "id int, toks array<string>"), k=2, rounds=1, n_terms=2).collect()
    [(most, model)] = made
    assert most == 3.0
    assert set(model.vocabulary) == {"half", "other", "few"}


def test_both_ways_of_two_blocks_come_from_one_product(monkeypatch):
    """Equal to two searches, ties and very many candidates included, at half the cosines."""
    rng = np.random.default_rng(8)
    strips, made = V._strips, []

    def counted(left, right):
        for s, u, w, sim in strips(left, right):
            made.append(sim.size)
            yield s, u, w, sim

    monkeypatch.setattr(V, "_strips", counted)
    monkeypatch.setattr(V, "PRODUCT", 1 << 12)
    monkeypatch.setattr(V, "WAITING", 1 << 10)
    normal, tied = rng.normal(size=(900, 12)), np.eye(12)[rng.integers(0, 12, 900)]
    for m in (normal, tied, np.ones((900, 12))):
        ids = rng.permutation(900)
        both = pd.DataFrame({"vec_id": ids, "v": list(m)})
        for cut in (0, 3, 400):
            left, right = both[:cut], both[cut:]
            once = V._gathered(V._nearest(left, right, 5) + V._nearest(right, left, 5))
            twice, made[:] = sum(made), []
            got = V._gathered(V._nearest_both(left, right, 5))
            assert 2 * sum(made) == twice
            made[:] = []
            order = ["src", "sim", "dst"]
            pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), once.sort_values(order, ignore_index=True))
