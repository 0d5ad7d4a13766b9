from collections import Counter

from pyspark.sql import functions as F

from lodemap.functions import text as tx
from lodemap.operators import concepts as C

TEXTS = [(1, "Ab, cd ab! Éf"), (2, ""), (3, None), (4, "cd cd xy ab cd"), (5, "ab")]


def units(spark):
    return C.token_units(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_keep_order_and_position(spark):
    got = [r for r in rows(C.tokens(units(spark))) if r[0] == 1]
    assert got == [(1, 0, "ab"), (1, 1, "cd"), (1, 2, "ab"), (1, 3, "éf")]


def test_ngrams_do_not_cross_units(spark):
    got = Counter(r["gram"] for r in C.ngrams(units(spark), 2).collect())
    assert got == {"ab cd": 2, "cd ab": 1, "ab éf": 1, "cd cd": 1, "cd xy": 1, "xy ab": 1}


def test_ngram_longer_than_text(spark):
    assert C.ngrams(units(spark), 9).count() == 0


def test_term_stats(spark):
    got = {r["concept"]: (r["tf"], r["df"]) for r in C.term_stats(units(spark)).collect()}
    assert got == {"ab": (4, 3), "cd": (4, 2), "éf": (1, 1), "xy": (1, 1)}


def test_fold(spark):
    got = spark.range(1).select(tx.fold(F.lit("ÉLÈVE Ñandú"))).first()[0]
    assert got == "eleve nandu"


def test_vocabulary_band_and_order(spark):
    stats = C.term_stats(units(spark))
    vocab = rows(C.vocabulary(stats, C.unit_count(units(spark)), min_df=1, max_df_frac=0.4, top=2))
    assert [(r[0], r[3]) for r in vocab] == [("cd", 0), ("xy", 1)]


def test_concept_sets_marker_keeps_empty_units(spark):
    vocab = spark.createDataFrame([("ab", 0), ("cd", 1)], "concept string, cid int")
    got = {r["doc_id"]: sorted(r["ids"]) for r in C.concept_sets(units(spark), vocab, marker=2).collect()}
    assert got == {1: [0, 1, 2], 2: [2], 3: [2], 4: [0, 1, 2], 5: [0, 2]}
    got = {r["doc_id"]: sorted(r["ids"]) for r in C.concept_sets(units(spark), vocab).collect()}
    assert got == {1: [0, 1], 4: [0, 1], 5: [0]}


def test_longest_match_wins(spark):
    entries = spark.createDataFrame([("ab", "A"), ("ab cd", "AB"), ("cd xy ab", "CXA")], "alias string, concept string")
    got = rows(C.match_dictionary(units(spark), entries).select("doc_id", "pos", "concept", "n_words"))
    assert got == [(1, 0, "AB", 2), (1, 2, "A", 1), (4, 1, "CXA", 3), (4, 3, "AB", 2), (5, 0, "A", 1)]


def test_approx_reach_is_near_df(spark, folder):
    from lodemap.plans import maps

    u = maps.doc_units(spark, folder)
    exact = C.term_stats(u).select("concept", "df")
    both = C.approx_reach(u, "doc_id", 0.05).join(exact, "concept")
    off = both.agg(F.avg(F.abs(F.col("reach") - F.col("df")) / F.col("df"))).first()[0]
    assert off < 0.05
    assert both.count() == exact.count()


def test_top_concepts_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("concept"), "id")
    top = C.top_concepts(df, ["g"], 3, score="id")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final
    assert {r["id"] for r in top.collect()} == {994, 995, 996, 997, 998, 999}


def test_quality_and_exact_copies(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "doc_id long, text string")
    good = spark.createDataFrame([(3, 1), (3, 1), (9, 1)], "doc_id long, quality int")
    assert [r["doc_id"] for r in C.quality_semi(docs, good).collect()] == [3]
    assert sorted(tuple(r) for r in C.dedup_exact(docs).collect()) == [(1, 2), (2, 1), (4, 2)]


def test_cube_of_statistics_equals_the_cube_of_mentions_and_shuffles_none(spark, folder):
    from lodemap.plans import catalog

    ment = catalog._doc_mentions(spark, folder)[0]
    rows = lambda df: sorted(map(str, df.select("concept", "lang", "source", "tf", "units", "all_lang", "all_source").collect()))
    cube = catalog.QUERIES["concept_cube"](spark, folder)
    assert rows(cube) == rows(C.concept_cube(ment)) != []
    assert "keys=[doc_id" not in cube._jdf.queryExecution().executedPlan().toString()
