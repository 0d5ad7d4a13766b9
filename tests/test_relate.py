import math

import pytest
from pyspark.sql import functions as F

from lodemap.operators import concepts as C, relate as R

TURNS = [
    (1, 0, "user", "red green"), (1, 1, "assistant", "blue red"), (1, 2, "user", "red"), (1, 3, "assistant", "blue"),
    (2, 0, "system", "red"), (2, 1, "user", "green"), (2, 2, "assistant", ""), (3, 0, "user", "red"),
    (4, 0, "user", ""), (4, 1, "assistant", "green"),
]


def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def vocab(spark):
    return spark.createDataFrame([("red", 0), ("green", 1), ("blue", 2)], "concept string, cid int")


def test_cue_response_by_hand(spark):
    got = {(r["cue"], r["resp"]): (r["n"], r["conf"], r["lift"]) for r in R.cue_response(turns(spark), vocab(spark), 3).collect()}
    # Four turn pairs; red is cue in two, green in two; blue is reply in two, red and green in one.
    assert got == {
        ("red", "blue"): (2, 1.0, 2.0), ("red", "red"): (1, 0.5, 2.0),
        ("green", "blue"): (1, 0.5, 1.0), ("green", "red"): (1, 0.5, 2.0),
    }


def test_lagged_arcs(spark):
    got = {(r["lag"], r["cue"], r["resp"]): r["n"] for r in R.lagged_arcs(turns(spark), vocab(spark), 3, k=2).collect()}
    assert got[1, "red", "blue"] == 2
    assert got[2, "red", "red"] == 1
    assert got[1, "red", "green"] == 1  # system turn, then user turn
    assert (2, "green", "green") not in got


def test_window_pairs_by_hand(spark):
    units = C.token_units(spark.createDataFrame([(1, "red x blue red green")], "doc_id long, text string"), "doc_id")
    got = {(r["src"], r["dst"]): r["n"] for r in R.cooccur_window(units, vocab(spark), 2).collect()}
    assert got == {("blue", "red"): 2, ("blue", "green"): 1, ("green", "red"): 1}


def test_bag_counts_units_once(spark):
    units = C.token_units(spark.createDataFrame([(1, "red red blue"), (2, "blue red"), (3, "red")], "doc_id long, text string"), "doc_id")
    assert [tuple(r) for r in R.cooccur_bag(units, vocab(spark), 3).collect()] == [("blue", "red", 2)]


def test_assoc_values(spark):
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, n long")
    stats = spark.createDataFrame([("a", 4), ("b", 2)], "concept string, df long")
    r = R.assoc(edges, stats, 10).first()
    assert r["pmi"] == round(math.log(2 * 10 / 8), 6)
    assert r["npmi"] == round(math.log(2.5) / -math.log(0.2), 6)
    assert (r["lift"], r["jaccard"], r["dice"]) == (2.5, 0.5, 0.666667)
    want = 2 * (2 * math.log(2 * 10 / 8) + 2 * math.log(2 * 10 / 32) + 6 * math.log(6 * 10 / 48))
    assert abs(r["g2"] - want) < 1e-5


def test_npmi_is_null_when_every_unit_has_the_pair(spark):
    edges = spark.createDataFrame([("a", "b", 5)], "src string, dst string, n long")
    stats = spark.createDataFrame([("a", 5), ("b", 5)], "concept string, df long")
    assert R.assoc(edges, stats, 5).first()["npmi"] is None


def test_subsumes(spark):
    edges = spark.createDataFrame([("a", "b", 4)], "src string, dst string, n long")
    stats = spark.createDataFrame([("a", 10), ("b", 5)], "concept string, df long")
    assert [tuple(r) for r in R.subsumes(edges, stats, 0.8).collect()] == [("a", "b", 4, 0.8, 0.4)]


def test_prune_keeps_an_edge_wanted_by_either_end(spark):
    edges = spark.createDataFrame([("a", "b", 9), ("a", "c", 8), ("a", "d", 1)], "src string, dst string, n long")
    assert {(r["src"], r["dst"]) for r in R.prune_topk(edges, 1).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    hub = edges.union(spark.createDataFrame([("c", "d", 7)], edges.schema))
    assert {(r["src"], r["dst"]) for r in R.prune_topk(hub, 1).collect()} == {("a", "b"), ("a", "c"), ("c", "d")}


def test_backbone_drops_even_stars_and_keeps_a_heavy_edge(spark):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "src long, dst long, w double")
    assert R.backbone(edges, 0.05).count() == 0
    heavy = edges.withColumn("w", F.when(F.col("dst") == 1, 100.0).otherwise(1.0))
    assert [(r["src"], r["dst"]) for r in R.backbone(heavy, 0.05).collect()] == [(0, 1)]


def test_merge_edges(spark):
    a = spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, w double")
    b = spark.createDataFrame([("a", "b", 4.0), ("b", "c", 1.0)], a.schema)
    got = {(r["src"], r["dst"]): r["w"] for r in R.merge_edges({"x": a, "y": b}, {"x": 1.0, "y": 0.5}).collect()}
    assert got == {("a", "b"): 4.0, ("b", "c"): 0.5}


def test_a_width_below_the_vocabulary_is_an_error(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "a b")], "conv_id long, turn long, role string, text string")
    vocab = spark.createDataFrame([("a", 2, 2, 0), ("b", 2, 2, 1)], "concept string, tf long, df long, cid int")
    with pytest.raises(ValueError, match="width 1"):
        R.cue_response(turns, vocab, 1)
