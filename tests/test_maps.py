from pyspark.sql import functions as F

from lodemap.plans import maps


def test_similarity_map_has_every_vector_once(spark, folder):
    out = maps.similarity_map(spark, folder, rounds=3)
    assert out.columns == ["node", "comp", "rank", "x", "y"]
    rows = out.agg(F.count("node").alias("n"), F.count_distinct("node").alias("d"), F.sum("rank").alias("s")).first()
    assert rows["n"] == rows["d"] == spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert abs(rows["s"] - 1) < 1e-9


def test_pruned_map_is_part_of_the_whole(spark, folder):
    band = maps.Band(min_df=2, top=300)
    whole = maps.conversation_map(spark, folder, band, min_n=2)
    pruned = maps.pruned_conversation_map(spark, folder, band, min_n=2, k=1)
    assert 0 < pruned.count() < whole.count()
    assert pruned.exceptAll(whole).count() == 0


def test_role_maps_cover_only_their_role(spark, folder):
    roles = {r["role"] for r in maps.role_edges(spark, folder).select("role").distinct().collect()}
    assert {"user", "assistant"} <= roles
