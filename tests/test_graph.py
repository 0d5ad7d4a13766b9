import random

import pytest
from pyspark.sql import functions as F

from lodemap.operators import graph as G

#  triangle 1-2-3, path 10-11-12-13, two 4-cliques 20..23 and 30..33 joined by 23-30, node 99 alone
CLIQUE = [(a, b) for base in (20, 30) for a in range(base, base + 4) for b in range(a + 1, base + 4)]
EDGES = [(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (12, 13), *CLIQUE, (23, 30)]
NODES = sorted({n for e in EDGES for n in e} | {99})


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n,) for n in NODES], "node long")
    edges = spark.createDataFrame([(a, b, 1) for a, b in EDGES], "src long, dst long, w long")
    return nodes, edges


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_degrees(graph):
    got = as_dict(G.degrees(graph[1]), "node", "deg")
    assert (got[1], got[10], got[11], got[23]) == (2, 1, 2, 4)


def test_components(graph):
    got = as_dict(G.components(*graph), "node", "comp")
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 99: 99}
    want.update({n: 20 for n in NODES if 20 <= n < 40})
    assert got == want


def test_components_of_a_long_path_in_few_rounds(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "src long, dst long")
    got = G.components(spark.range(n).withColumnRenamed("id", "node"), edges, max_rounds=12)
    assert {r["comp"] for r in got.collect()} == {0}


def test_components_of_string_ids_and_no_edges(spark):
    nodes = spark.createDataFrame([("b",), ("a",), ("c",)], "node string")
    edges = spark.createDataFrame([("b", "c")], "src string, dst string")
    assert as_dict(G.components(nodes, edges), "node", "comp") == {"a": "a", "b": "b", "c": "b"}
    assert as_dict(G.components(nodes, edges.limit(0)), "node", "comp") == {"a": "a", "b": "b", "c": "c"}


def test_round_limit_raises(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(G.NotConverged):
        G.components(spark.range(201).withColumnRenamed("id", "node"), edges, max_rounds=1)


def test_pagerank_sums_to_one_with_a_dangling_node(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    arcs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    got = as_dict(G.pagerank(nodes, arcs, rounds=3), "node", "rank")
    rank = {n: 1 / 3 for n in (1, 2, 3)}
    for _ in range(3):
        lost = rank[3] / 3
        rank = {
            1: 0.05 + 0.85 * lost,
            2: 0.05 + 0.85 * (rank[1] / 2 + lost),
            3: 0.05 + 0.85 * (rank[1] / 2 + rank[2] + lost),
        }
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[n] - rank[n]) < 1e-9 for n in rank)


def test_labels_fill_cliques(graph):
    got = as_dict(G.label_propagation(*graph, rounds=6), "node", "label")
    assert len({got[n] for n in (20, 21, 22)}) == 1
    assert got[99] == 99


def test_triangles(graph):
    rows = {r["node"]: r for r in G.triangles(*graph).collect()}
    assert (rows[1]["triangles"], rows[1]["clustering"]) == (1, 1.0)
    assert (rows[20]["triangles"], rows[20]["clustering"]) == (3, 1.0)
    assert (rows[23]["triangles"], rows[23]["clustering"]) == (3, 0.5)
    assert (rows[11]["triangles"], rows[99]["deg"]) == (0, 0)


def test_triangles_of_a_hub_equal_brute_force(spark):
    rnd = random.Random(4)
    pairs = {(0, i) for i in range(1, 60)} | {tuple(sorted(rnd.sample(range(1, 60), 2))) for _ in range(150)}
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in range(60)}
    want = {n: sum(1 for a in near[n] for b in near[n] if a < b and b in near[a]) for n in range(60)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert as_dict(G.triangles(spark.range(60).withColumnRenamed("id", "node"), edges), "node", "triangles") == want


def test_hops_and_predecessors(spark, graph):
    seeds = spark.createDataFrame([(20,)], "node long")
    rows = {r["node"]: (r["hop"], r["pred"]) for r in G.paths(graph[1], seeds, 5).collect()}
    assert rows[20] == (0, None)
    assert rows[23] == (1, 20)
    assert rows[30] == (2, 23)
    assert rows[33] == (3, 30)
    assert 1 not in rows
    assert set(as_dict(G.k_hop(graph[1], seeds, 1), "node", "hop")) == {20, 21, 22, 23}


def test_modularity_and_quotient(spark):
    edges = spark.createDataFrame([(a, b, 1) for a, b in [*CLIQUE, (23, 30)]], "src long, dst long, w long")
    labels = spark.createDataFrame([(n, n // 10) for n in range(20, 34) if n % 10 < 4], "node long, label long")
    row = G.modularity(edges, labels).first()
    assert (row["n_labels"], row["q"]) == (2, round(12 / 13 - 2 * (13 / 26) ** 2, 6))
    got = {(r["src"], r["dst"]): r["n"] for r in G.quotient(edges, labels).collect()}
    assert got == {(2, 2): 6, (3, 3): 6, (2, 3): 1}


def test_k_core(graph):
    got = {(r["src"], r["dst"]) for r in G.k_core(graph[1], 3).collect()}
    assert got == set(CLIQUE) | {(23, 30)}
    assert G.k_core(graph[1], 4).count() == 0


def kruskal(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    kept = set()
    for w, a, b in sorted((-w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            kept.add((a, b))
    return kept


def test_spanning_forest_equals_kruskal(spark):
    rnd = random.Random(7)
    edges = sorted({(a, b): rnd.randint(1, 5) for a, b in (sorted(rnd.sample(range(80), 2)) for _ in range(160))}.items())
    edges = [(a, b, w) for (a, b), w in edges]
    nodes = spark.range(85).withColumnRenamed("id", "node")
    got = G.spanning_forest(nodes, spark.createDataFrame(edges, "src long, dst long, w long"))
    assert {(r["src"], r["dst"]) for r in got.collect()} == kruskal(range(85), edges)
    assert got.count() == len(kruskal(range(85), edges))


def test_spanning_forest_without_edges(spark, graph):
    assert G.spanning_forest(graph[0], graph[1].limit(0)).count() == 0


def test_the_partition_of_a_hub_is_split(spark):
    """With broadcasts off, a join of edges on a hub with a third of them is divided by AQE."""
    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        n = 30_000
        edges = spark.range(n, numPartitions=8).selectExpr("if(id % 3 = 0, 0, id % 997 + 1) AS src", "id + 1000 AS dst")
        ranks = spark.range(1000).selectExpr("id AS src", "1.0D AS rank")
        sums = edges.join(ranks, "src").groupBy("dst").sum("rank")
        assert sums.count() == n
        sums = edges.join(ranks, "src").groupBy("dst").sum("rank")
        sums.collect()
        assert "skew=true" in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_k_core_of_a_long_path_ends(spark):
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.k_core(path, 2).count() == 0


def test_star_steps_join_scans_that_spark_can_split(spark):
    """With a hub and no broadcast, both star steps of the operator itself are split by AQE."""
    from lodemap.scratch import Scratch

    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("src"), (F.col("id") + 1).alias("dst"))
        scratch = Scratch(spark, "skew")
        pairs = scratch.table(edges.repartition(8), "pairs")
        low = scratch.table(pairs.groupBy("src").agg(F.min("dst").alias("m")), "low")
        out = G._stars(pairs, True, scratch, "a").groupBy().count()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString(), low
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
