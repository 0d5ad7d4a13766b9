"""Every registered query: name -> (spark, folder of Parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodemap.functions import text as tx
from lodemap.operators import compare as M, concepts as C, display as D, graph as G, groups as E, near as N, relate as R, vectors as V
from lodemap.plans import maps
from lodemap.plans.maps import DOC_BAND, TURN_BAND, WHOLE_BAND
from lodemap.scratch import Scratch
from lodemap.sources import parse_relations, read_documents, read_turns, read_vectors, stream_events, write_map
from lodemap.sources.readers import read_events
from lodemap.sources.sinks import top_map
from lodemap.streaming import trends as S
from lodemap.streaming.edges import read_edges, upsert_edges as upsert_edges_of
from lodemap.streaming.progress import late_rows as late_rows_of, progress_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ---------------------------------------------------------------

@query
def turns_scan(spark, folder):
    return read_turns(spark, folder).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn")
    )


@query
def documents_scan(spark, folder):
    return read_documents(spark, folder, lang="en").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query
def vectors_scan(spark, folder):
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return read_vectors(spark, folder).select("vec_id", "label", F.size("v").alias("dim"), F.round(norm, 6).alias("norm"))


def _stream_table(spark, folder, name: str, build) -> DataFrame:
    """Run a stream over the events of `folder` into files and scan them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    scratch = Scratch(spark, name)
    stream = build(stream_events(spark, folder))
    S.run_to_table(stream, scratch.path("out"), scratch.path("checkpoint"))
    return spark.read.schema(stream.schema).parquet(scratch.path("out"))


@query
def event_stream(spark, folder):
    events = _stream_table(spark, folder, "events", lambda ev: ev)
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"), _stamp(F.max("ts")).alias("last_ts")
    )


def _recorded(spark, folder):
    """Turns as recorded JSON: word pairs as triples; system turns stay prose, not JSON."""
    pair = F.arrays_zip(F.col("toks").alias("s"), tx.ahead("toks", 1).alias("o"))
    triples = F.transform(
        F.filter(pair, lambda p: p["o"].isNotNull()),
        lambda p: F.struct(p["s"].alias("subject"), F.lit("before").alias("relation"), p["o"].alias("object")),
    )
    turns = read_turns(spark, folder).withColumn("toks", tx.words("text"))
    said = F.when(F.col("role") == "system", F.col("text")).otherwise(F.to_json(triples))
    return turns.select("conv_id", "turn", said.alias("said"))


@query
def relations_parsed(spark, folder):
    rows, _ = parse_relations(_recorded(spark, folder), "said")
    return rows.groupBy("subject", "relation", "object").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations")
    )


@query
def relations_rejected(spark, folder):
    _, rejects = parse_relations(_recorded(spark, folder), "said")
    return rejects.select("conv_id", "turn", F.length("said").alias("chars"))


@query
def map_written(spark, folder):
    """Write two maps, write one of them again, read both back."""
    path = Scratch(spark, "map").path("out")
    nodes, _, edges = maps.neighbour_map(spark, folder)
    write_map(nodes, edges, path, "near")
    write_map(nodes, edges.where(F.col("w") >= 400_000), path, "strong")
    write_map(nodes, edges, path, "near")
    return spark.read.schema("src long, dst long, w long, map_id string").parquet(f"{path}/edges")


@query
def top_map_nodes(spark, folder):
    nodes, edges = _scored_map(spark, folder)
    return top_map(nodes, edges, 100)[0]


@query
def top_map_edges(spark, folder):
    nodes, edges = _scored_map(spark, folder)
    return top_map(nodes, edges, 100)[1]


def _scored_map(spark, folder):
    _, _, edges = maps.neighbour_map(spark, folder)
    return G.degrees(edges).select("node", F.col("strength").alias("score")), edges


# --- concept mentions ----------------------------------------------------------------

@query
def tokens(spark, folder):
    return C.tokens(maps.turn_units(spark, folder))


@query
def ngrams(spark, folder):
    return C.ngrams(maps.turn_units(spark, folder), 3).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )


@query
def folded_labels(spark, folder):
    return C.fold_labels(C.term_stats(maps.doc_units(spark, folder)))


@query
def term_stats(spark, folder):
    return C.term_stats(maps.doc_units(spark, folder))


@query
def term_stats_by_lang(spark, folder):
    return C.term_stats(maps.doc_units(spark, folder), by=["lang"])


@query
def vocabulary(spark, folder):
    units = maps.doc_units(spark, folder)
    return C.vocabulary(C.term_stats(units), C.unit_count(units), DOC_BAND.min_df, DOC_BAND.max_df_frac, top=DOC_BAND.top)


def _doc_mentions(spark, folder):
    units = maps.doc_units(spark, folder)
    vocab = maps.written_vocabulary(units, WHOLE_BAND)
    return C.mentions(units, vocab), vocab, units


def _doc_stats(spark, folder):
    """tf and df by language and source of the vocabulary's concepts, from one pass over the texts."""
    units = maps.doc_units(spark, folder)
    stats = Scratch(spark, "stats").table(C.term_stats(units, by=["lang", "source"]), "by-group")
    whole = stats.groupBy("concept").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    vocab = C.vocabulary(whole, C.unit_count(units), WHOLE_BAND.min_df, WHOLE_BAND.max_df_frac, top=WHOLE_BAND.top)
    return stats.join(vocab.select("concept"), "concept", "left_semi")


@query
def mentions(spark, folder):
    return _doc_mentions(spark, folder)[0].select("doc_id", "concept", "tf")


@query
def quality_semi(spark, folder):
    """Documents that are marked as good, as a choice of what a map is made from."""
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    return C.quality_semi(read_documents(spark, folder), good).select("doc_id", "source")


@query
def dedup_exact(spark, folder):
    """One document of each text, so that copies do not count as evidence."""
    return C.dedup_exact(read_documents(spark, folder))


@query
def dedup_near(spark, folder):
    """Groups of near copies, by shingles of five words and a similarity of 0.8."""
    return N.dedup_near(read_documents(spark, folder))


@query
def stopwords_removed(spark, folder):
    """Turn tokens without the concepts that are in over a tenth of all turns."""
    units = maps.turn_units(spark, folder)
    stats = C.term_stats(units)
    stop = stats.where(F.col("df") > F.lit(0.1) * C.unit_count(units)).select("concept")
    stop = Scratch(spark, "stop").table(stop, "list")
    return C.stopword_anti(C.tokens(units), stop).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("left_over"))


@query
def tfidf(spark, folder):
    units = maps.turn_units(spark, folder)
    vocab = maps.written_vocabulary(units, WHOLE_BAND)
    ment = C.mentions(units, vocab)
    return C.tfidf(ment, vocab, C.unit_count(units)).select("conv_id", "turn", "concept", "tf", "score")


@query
def top_concepts(spark, folder):
    per = _doc_stats(spark, folder).groupBy("source", "concept").agg(F.sum("tf").alias("tf"))
    return C.top_concepts(per, ["source"], 5, score="tf")


@query
def collocations(spark, folder):
    return C.collocations(maps.doc_units(spark, folder), min_n=10)


@query
def dictionary_matches(spark, folder):
    """Turn positions that match a dictionary of the most frequent 1-, 2- and 3-grams."""
    units = maps.turn_units(spark, folder)
    parts = []
    for size in (1, 2, 3):
        grams = C.ngrams(units, size).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        parts.append(grams.orderBy(F.desc("n"), "gram").limit(100).select(F.col("gram").alias("alias")))
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    dictionary = Scratch(spark, "dictionary").table(entries.withColumn("concept", tx.fold("alias")), "entries")
    found = C.match_dictionary(units, dictionary)
    return found.select("conv_id", "turn", "pos", "concept", "n_words")


@query
def approx_reach(spark, folder):
    return C.approx_reach(maps.doc_units(spark, folder), "doc_id")


@query
def concept_cube(spark, folder):
    return C.cube_of(_doc_stats(spark, folder))


# --- relations -----------------------------------------------------------------------

def _bag(spark, folder):
    units = maps.doc_units(spark, folder)
    vocab = maps.written_vocabulary(units, DOC_BAND)
    edges = Scratch(spark, "bag").table(R.cooccur_bag(units, vocab, DOC_BAND.top), "edges")
    return edges, vocab, units


@query
def cooccur_bag(spark, folder):
    units = maps.doc_units(spark, folder)
    return R.cooccur_bag(units, maps.written_vocabulary(units, DOC_BAND), DOC_BAND.top)


@query
def cooccur_window(spark, folder):
    units = maps.doc_units(spark, folder)
    return R.cooccur_window(units, maps.written_vocabulary(units, DOC_BAND), 5)


@query
def assoc(spark, folder):
    edges, vocab, units = _bag(spark, folder)
    return R.assoc(edges, vocab, C.unit_count(units))


@query
def cue_response(spark, folder):
    return maps.conversation_map(spark, folder)


@query
def pruned_arcs(spark, folder):
    return maps.pruned_conversation_map(spark, folder)


@query
def lagged_arcs(spark, folder):
    turns = read_turns(spark, folder)
    vocab = maps.written_vocabulary(C.token_units(turns, "conv_id", "turn"), TURN_BAND)
    return R.lagged_arcs(turns, vocab, TURN_BAND.top, k=3, min_n=5)


@query
def subsumes(spark, folder):
    edges, vocab, _ = _bag(spark, folder)
    return R.subsumes(edges, vocab, 0.6)


@query
def knn_exact(spark, folder):
    return V.knn_exact(read_vectors(spark, folder), 5)


@query
def knn_approx(spark, folder):
    return V.knn_approx(read_vectors(spark, folder), 5)


@query
def knn_recall(spark, folder):
    vectors = read_vectors(spark, folder)
    found = V.recall(V.knn_approx(vectors, 5), V.knn_exact(vectors, 5))
    return found.select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query
def similar_pairs(spark, folder):
    return V.similar_pairs(read_vectors(spark, folder), 0.4)


@query
def similar_pairs_approx(spark, folder):
    return V.similar_pairs_approx(read_vectors(spark, folder), 0.4)


@query
def mutual_neighbours(spark, folder):
    return V.mutual(V.knn_exact(read_vectors(spark, folder), 5))


@query
def pruned_edges(spark, folder):
    units = maps.doc_units(spark, folder)
    edges = R.cooccur_window(units, maps.written_vocabulary(units, DOC_BAND), 5)
    return R.prune_topk(edges, k=5, min_n=3)


@query
def backbone(spark, folder):
    units = maps.doc_units(spark, folder)
    edges = R.cooccur_window(units, maps.written_vocabulary(units, DOC_BAND), 5)
    return R.backbone(edges.withColumnRenamed("n", "w"), alpha=0.05)


@query
def merged_edges(spark, folder):
    """Window and bag evidence on the same concepts, summed with weights."""
    units = maps.doc_units(spark, folder)
    vocab = maps.written_vocabulary(units, DOC_BAND)
    near = R.cooccur_window(units, vocab, 5).withColumnRenamed("n", "w")
    bag = R.cooccur_bag(units, vocab, DOC_BAND.top).withColumnRenamed("n", "w")
    return R.merge_edges({"window": near, "bag": bag}, {"window": 1.0, "bag": 0.5})


# --- graph analysis ------------------------------------------------------------------

@query
def degrees(spark, folder):
    return G.degrees(maps.neighbour_map(spark, folder)[2])


@query
def components(spark, folder):
    nodes, knn, _ = maps.neighbour_map(spark, folder)
    return G.components(nodes, V.mutual(knn))


@query
def pagerank(spark, folder):
    nodes, knn, _ = maps.neighbour_map(spark, folder)
    ranks = G.pagerank(nodes, knn, rounds=10)
    return ranks.select("node", F.round("rank", 8).alias("rank"))


@query
def label_propagation(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    return G.label_propagation(nodes, edges, rounds=5)


@query
def triangles(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    return G.triangles(nodes, edges)


def _seeds(nodes):
    """The node with the smallest id."""
    return nodes.agg(F.min("node").alias("node"))


@query
def k_hop(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    return G.k_hop(edges, _seeds(nodes), 3)


@query
def paths(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    return G.paths(edges, _seeds(nodes), 6)


def _vector_labels(spark, folder):
    return read_vectors(spark, folder).select(F.col("vec_id").alias("node"), "label")


@query
def modularity(spark, folder):
    return G.modularity(maps.neighbour_map(spark, folder)[2], _vector_labels(spark, folder))


@query
def quotient(spark, folder):
    return G.quotient(maps.neighbour_map(spark, folder)[2], _vector_labels(spark, folder))


@query
def k_core(spark, folder):
    """The 3-core of the mutual neighbours."""
    return G.k_core(V.mutual(maps.neighbour_map(spark, folder)[1]), 3)


@query
def spanning_forest(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    return G.spanning_forest(nodes, edges)


# --- groups --------------------------------------------------------------------------

@query
def kmeans(spark, folder):
    return E.kmeans(read_vectors(spark, folder), 10)


@query
def hierarchy(spark, folder):
    return E.hierarchy(read_vectors(spark, folder), 8)


@query
def cluster_profile(spark, folder):
    return E.cluster_profile(read_vectors(spark, folder).withColumnRenamed("label", "cluster"))


@query
def cluster_names(spark, folder):
    return E.cluster_names(_doc_mentions(spark, folder)[0], "lang", 10)


@query
def agreement(spark, folder):
    """Labels against the quadrant of the first two dimensions."""
    quadrant = F.when(F.col("v")[0] > 0, 1).otherwise(0) + F.when(F.col("v")[1] > 0, 2).otherwise(0)
    return E.agreement(read_vectors(spark, folder).select("label", quadrant.alias("quadrant")), "label", "quadrant")


@query
def topics(spark, folder):
    units = C.token_units(read_turns(spark, folder), "conv_id", "turn")
    return E.topics(units, k=5)


# --- display -------------------------------------------------------------------------

@query
def project_pca(spark, folder):
    return D.project_pca(read_vectors(spark, folder))


@query
def similarity_map(spark, folder):
    return maps.similarity_map(spark, folder)


@query
def layout_force(spark, folder):
    nodes, _, edges = maps.neighbour_map(spark, folder)
    placed = D.layout_force(nodes, edges, rounds=5)
    return placed.select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _placed(spark, folder):
    """Vectors placed by their first two dimensions and scored by the third."""
    v = F.col("v")
    return read_vectors(spark, folder).select(
        F.col("vec_id").alias("node"), v[0].alias("x"), v[1].alias("y"), F.round(v[2], 6).alias("score")
    )


@query
def tiles(spark, folder):
    cut = D.tiles(_placed(spark, folder), z_max=5, k=3)
    return cut.select("z", "tx", "ty", "n", F.inline("top"))


@query
def viewport(spark, folder):
    return D.viewport(_placed(spark, folder), (-0.1, -0.1, 0.15, 0.2), 25).select(
        "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "score"
    )


@query
def bundle_edges(spark, folder):
    return D.bundle_edges(_placed(spark, folder), maps.neighbour_map(spark, folder)[2], z=4)


@query
def concept_map(spark, folder):
    return maps.concept_map(spark, folder)


@query
def concept_tiles(spark, folder):
    """Zoom tiles of the concept map: the three best-ranked concepts of each cell."""
    nodes = maps.concept_map(spark, folder).select(F.col("concept").alias("node"), "x", "y", F.col("rank").alias("score"))
    return D.tiles(nodes, z_max=4, k=3, low=0.0, high=1.0).select("z", "tx", "ty", "n", F.inline("top"))


# --- comparing maps ------------------------------------------------------------------

def _two_maps(spark, folder):
    edges = Scratch(spark, "roles").table(maps.role_edges(spark, folder), "edges")
    return edges.where("role = 'user'").drop("role"), edges.where("role = 'assistant'").drop("role")


@query
def map_diff(spark, folder):
    return M.map_diff(*_two_maps(spark, folder))


@query
def rank_shift(spark, folder):
    stats = C.term_stats(maps.turn_units(spark, folder), by=["role"])
    return M.rank_shift(Scratch(spark, "ranks").table(stats, "stats"), "role")


def _role_stats(spark, folder):
    stats = C.term_stats(maps.turn_units(spark, folder), by=["role"])
    stats = Scratch(spark, "roles").table(stats, "stats")
    return stats.where("role = 'user'"), stats.where("role = 'assistant'")


@query
def shared_concepts(spark, folder):
    return M.shared(*_role_stats(spark, folder))


@query
def only_in_replies(spark, folder):
    user, assistant = _role_stats(spark, folder)
    return M.only_in(assistant, user)


@query
def neighbour_overlap(spark, folder):
    return M.neighbour_overlap(*_two_maps(spark, folder))


@query
def drift(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    daily = read_events(spark, folder).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return M.drift(daily, "event_type", "day")


# --- streaming -----------------------------------------------------------------------

def _stamp(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _windows(df):
    return df.select(_stamp("start").alias("start"), _stamp("end").alias("end"), "concept", "n", "value")


@query
def trend_tumbling(spark, folder):
    return _windows(_stream_table(spark, folder, "tumbling", lambda ev: S.trend_tumbling(ev, "6 hours", "1 hour")))


@query
def trend_sliding(spark, folder):
    return _windows(_stream_table(spark, folder, "sliding", lambda ev: S.trend_sliding(ev, "1 day", "6 hours", "1 hour")))


@query
def sessions(spark, folder):
    out = _stream_table(spark, folder, "sessions", lambda ev: S.sessions(ev, "3 hours", "1 hour"))
    return out.select("user_id", _stamp("start").alias("start"), _stamp("end").alias("end"), "n", "concepts")


@query
def dedup_stream(spark, folder):
    """Every event sent twice; one row per event is left."""
    out = _stream_table(spark, folder, "dedup", lambda ev: S.dedup_stream(
        ev.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "1 hour"
    ))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


def _bands(spark, folder):
    """A written dictionary of the values that `props` takes below 90, in bands of ten."""
    k = F.from_json("props", "map<string,string>")["k"].cast("bigint")
    entries = read_events(spark, folder).select(k.alias("k")).where("k < 90").distinct()
    entries = entries.withColumn("concept", F.concat(F.lit("band"), F.floor(F.col("k") / 10)))
    return Scratch(spark, "bands").table(entries, "entries")


@query
def tag_stream(spark, folder):
    """Events tagged by their band, those outside the dictionary included."""
    dictionary = _bands(spark, folder)
    out = _stream_table(spark, folder, "tags", lambda ev: S.tag_stream(ev, dictionary))
    return out.groupBy("concept", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def tagged_trend(spark, folder):
    """Events tagged from a dictionary and counted per tag and closed window, in one stream."""
    dictionary = _bands(spark, folder)
    return _windows(_stream_table(
        spark, folder, "tagged", lambda ev: S.trend_tumbling(S.tag_stream(ev, dictionary), "1 day", "1 hour", "concept")
    ))


@query
def upsert_edges(spark, folder):
    scratch = Scratch(spark, "upsert")
    upsert_edges_of(stream_events(spark, folder), scratch.path("edges"), scratch.path("checkpoint")).awaitTermination()
    return read_edges(spark, scratch.path("edges"))


@query
def late_rows(spark, folder):
    """Events sent in two waves, the later half of the time first: what the watermark drops.

    Duplicate removal keeps single rows, so the dropped rows are counted exactly.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    scratch = Scratch(spark, "late")
    raw = spark.read.parquet(f"{folder}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    is_late = 2 * at < raw.agg(F.min(at) + F.max(at)).scalar()
    wave = scratch.path("wave")
    raw.where(~is_late).write.mode("append").parquet(wave)
    stream = stream_events(spark, wave, pattern="*.parquet")
    S.run_to_table(S.dedup_stream(stream, "1 hour"), scratch.path("out"), scratch.path("checkpoint"))
    raw.where(is_late).write.mode("append").parquet(wave)
    with progress_of(spark, scratch.path("reports")) as reports:
        second = S.run_to_table(S.dedup_stream(stream, "1 hour"), scratch.path("out"), scratch.path("checkpoint"))
        reports.wait(str(second.runId))
        report = late_rows_of(reports.read())
    return report.agg(F.sum("n_input").alias("n_input"), F.sum("n_dropped").alias("n_dropped"))
