import json

import numpy as np
import pytest

from lodemap.operators import compare as M, display as D
from lodemap.scratch import Scratch, shared_dir
from lodemap.sources import export_top, parse_relations, read_documents, write_map
from lodemap.sources.sinks import top_map

TRIPLES = [
    (1, '[{"subject":"a","relation":"is","object":"b"},{"subject":"b","relation":"is","object":"c"}]'),
    (2, "[]"), (7, '{"subject":"a","relation":"is","object":"b"}'), (3, "not json"), (4, '[{"subject":"a","relation":"is"}]'), (5, None), (6, '[{"subject":"a"'),
]


def test_parse_relations_and_rejects(spark):
    rows, rejects = parse_relations(spark.createDataFrame(TRIPLES, "id long, said string"), "said")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", "is", "b"), (1, "b", "is", "c")]
    assert sorted(r["id"] for r in rejects.collect()) == [3, 4, 5, 6, 7]


def test_filters_and_columns_reach_the_scan(spark, folder):
    df = read_documents(spark, folder, lang="en", source="src1").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "EqualTo(source,src1)" in plan
    assert "text" not in plan.split("ReadSchema")[1].splitlines()[0]


def map_tables(spark):
    nodes = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.8), (4, 0.1)], "node long, score double")
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 3)], "src long, dst long, n long")
    return nodes, edges


def test_write_map_replaces_one_map_only(spark, tmp_path):
    nodes, edges = map_tables(spark)
    path = str(tmp_path / "maps")
    write_map(nodes, edges, path, "a")
    write_map(nodes, edges, path, "b")
    write_map(nodes.limit(1), edges.limit(1), path, "b")
    back = spark.read.parquet(f"{path}/edges")
    assert {r["map_id"]: r["count"] for r in back.groupBy("map_id").count().collect()} == {"a": 3, "b": 1}
    write_map(nodes, edges.limit(0), path, "a")
    back = spark.read.parquet(f"{path}/edges")
    assert {r["map_id"] for r in back.collect()} == {"b"}


def test_export_top(spark, tmp_path):
    nodes, edges = map_tables(spark)
    best, inside = top_map(nodes, edges, 3)
    assert {r["node"] for r in best.collect()} == {1, 2, 3}
    assert {(r["src"], r["dst"]) for r in inside.collect()} == {(1, 2), (2, 3)}
    export_top(nodes, edges, 2, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out" / "nodes").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["node"] for x in lines} == {1, 2}


def test_scratch_is_in_the_named_folder_and_drops_tables(spark):
    scratch = Scratch(spark, "t")
    assert scratch.root.startswith(shared_dir(spark))
    scratch.table(spark.range(3), "a")
    assert scratch.table(spark.range(5), "b").count() == 5
    scratch.drop("a")
    with pytest.raises(Exception):
        spark.read.parquet(scratch.path("a"))


def test_pca_axes_and_signs(spark):
    rng = np.random.default_rng(2)
    m = np.column_stack([rng.normal(0, 5, 80), rng.normal(0, 2, 80), rng.normal(0, 0.1, 80)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, v array<double>")
    got = np.array([[r["x"], r["y"]] for r in D.project_pca(df).orderBy("vec_id").collect()])
    assert np.corrcoef(got[:, 0], m[:, 0])[0, 1] > 0.99
    assert np.corrcoef(got[:, 1], m[:, 1])[0, 1] > 0.99


def test_layout_is_repeatable_and_pulls_neighbours_together(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double")
    nodes = spark.createDataFrame([(n,) for base in (0, 10) for n in range(base, base + 6)], "node long")

    def run():
        return {r["node"]: (r["x"], r["y"]) for r in D.layout_force(nodes, edges, rounds=12, seed=5).collect()}

    one, two = run(), run()
    assert one.keys() == two.keys()
    assert all(abs(one[n][i] - two[n][i]) < 1e-6 for n in one for i in (0, 1))
    assert all(0 <= c < 1 for xy in one.values() for c in xy)
    p = {n: np.array(xy) for n, xy in one.items()}
    inner = np.mean([np.linalg.norm(p[a] - p[b]) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6) if a < b])
    outer = np.mean([np.linalg.norm(p[a] - p[b]) for a in range(6) for b in range(10, 16)])
    assert inner < outer


def placed(spark):
    rows = [(1, -0.9, -0.9, 3.0), (2, -0.8, -0.8, 5.0), (3, 0.9, 0.9, 1.0), (4, 1.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "node long, x double, y double, score double")


def test_tiles_by_hand(spark):
    got = {(r["z"], r["tx"], r["ty"]): (r["n"], [t["node"] for t in r["top"]]) for r in D.tiles(placed(spark), 1, 2).collect()}
    assert got == {(0, 0, 0): (4, [2, 1]), (1, 0, 0): (2, [2, 1]), (1, 1, 1): (2, [4, 3])}


def test_viewport_and_bundles(spark):
    assert [r["node"] for r in D.viewport(placed(spark), (-1, -1, 0, 0), 1).collect()] == [2]
    edges = spark.createDataFrame([(1, 3, 2), (2, 4, 3), (1, 2, 7)], "src long, dst long, w long")
    got = {(r["ax"], r["ay"], r["bx"], r["by"]): (r["n"], r["w"]) for r in D.bundle_edges(placed(spark), edges, 1).collect()}
    assert got == {(0, 0, 1, 1): (2, 5), (0, 0, 0, 0): (1, 7)}


def test_map_diff_and_overlap(spark):
    a = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "src string, dst string, n long")
    b = spark.createDataFrame([("a", "c", 5), ("c", "d", 1)], a.schema)
    got = {(r["src"], r["dst"]): (r["status"], r["delta"]) for r in M.map_diff(a, b).collect()}
    assert got == {("a", "b"): ("removed", -1), ("a", "c"): ("changed", 3), ("c", "d"): ("added", 1)}
    got = {r["concept"]: (r["n_both"], r["n_either"]) for r in M.neighbour_overlap(a, b).collect()}
    assert got == {"a": (1, 2), "b": (0, 1), "c": (1, 2), "d": (0, 1)}


def test_shared_and_only_in(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "concept string")
    b = spark.createDataFrame([("y",), ("z",)], "concept string")
    assert [r["concept"] for r in M.shared(a, b).collect()] == ["y"]
    assert [r["concept"] for r in M.only_in(a, b).collect()] == ["x"]


def test_rank_shift(spark):
    rows = [("u", "x", 5), ("u", "y", 3), ("a", "y", 9), ("a", "z", 9)]
    stats = spark.createDataFrame(rows, "role string, concept string, df long")
    got = {(r["role"], r["concept"]): (r["rank"], r["rank_all"], r["shift"]) for r in M.rank_shift(stats, "role").collect()}
    assert got == {("u", "x"): (1, 3, 2), ("u", "y"): (2, 1, -1), ("a", "y"): (1, 1, 0), ("a", "z"): (1, 2, 1)}


def test_drift(spark):
    stats = spark.createDataFrame([("k", d, n) for d, n in enumerate([3, 6, 6, 0])], "event_type string, day int, n long")
    got = [(r["change"], r["mean3"]) for r in M.drift(stats, "event_type", "day").orderBy("day").collect()]
    assert got == [(None, 3.0), (3, 4.5), (0, 5.0), (-6, 4.0)]


def test_nodes_outside_the_range_have_tiles_of_their_own(spark):
    nodes = spark.createDataFrame([(1, -0.5, -0.5, 1.0), (2, 1.0, 1.0, 1.0), (3, 1.2, -3.0, 1.0)], "node long, x double, y double, score double")
    got = {(r["z"], r["tx"], r["ty"]): r["n"] for r in D.tiles(nodes, 1, 2).collect()}
    assert got == {(1, 0, 0): 1, (1, 1, 1): 1, (1, 2, -2): 1, (0, 0, 0): 2, (0, 1, -1): 1}
