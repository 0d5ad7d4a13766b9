"""Whole maps: the operators put together from tables to a result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodemap.operators import concepts as C, display as D, graph as G, relate as R, vectors as V
from lodemap.scratch import Scratch
from lodemap.sources import read_documents, read_turns, read_vectors


@dataclass(frozen=True)
class Band:
    """Which concepts a map has: least df, greatest share of units, and for counting pairs, how many."""

    min_df: int = 3
    max_df_frac: float = 0.2
    top: int | None = None


WHOLE_BAND = Band()
DOC_BAND = Band(top=500)
TURN_BAND = Band(top=2000)


def doc_units(spark: SparkSession, folder: str) -> DataFrame:
    return C.token_units(read_documents(spark, folder), "doc_id", "lang", "source")


def turn_units(spark: SparkSession, folder: str) -> DataFrame:
    return C.token_units(read_turns(spark, folder), "conv_id", "turn", "role")


def written_vocabulary(units: DataFrame, band: Band) -> DataFrame:
    """The vocabulary as a written table: its size is known to every join that follows."""
    vocab = C.vocabulary(C.term_stats(units), C.unit_count(units), band.min_df, band.max_df_frac, top=band.top)
    return Scratch(units.sparkSession, "vocabulary").table(vocab, "vocab")


def conversation_map(spark: SparkSession, folder: str, band: Band = TURN_BAND, min_n: int = 3) -> DataFrame:
    """Directed concept map of a table of conversations: all cue -> response arcs."""
    turns = read_turns(spark, folder)
    vocab = written_vocabulary(C.token_units(turns, "conv_id", "turn"), band)
    return R.cue_response(turns, vocab, band.top, min_n)


def pruned_conversation_map(spark: SparkSession, folder: str, band: Band = TURN_BAND, min_n: int = 3, k: int = 5) -> DataFrame:
    """The conversation map with the k heaviest arcs out of each cue or into each response."""
    return R.prune_arcs(conversation_map(spark, folder, band, min_n), k)


def neighbour_map(spark: SparkSession, folder: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similarity map of a table of vectors: nodes, the neighbour table, undirected edges.

    The neighbour table is written, since nothing costs as much to compute again.
    """
    vectors = read_vectors(spark, folder)
    knn = Scratch(spark, "neighbours").table(V.knn_exact(vectors, k), "knn")
    nodes = vectors.select(F.col("vec_id").alias("node"))
    return nodes, knn, V.knn_edges(knn)


def similarity_map(spark: SparkSession, folder: str, k: int = 5, rounds: int = 10) -> DataFrame:
    """The nodes of a similarity map: vec_id, component of the mutual neighbours, PageRank over
    the neighbour arcs, and display coordinates."""
    vectors = read_vectors(spark, folder)
    nodes, knn, _ = neighbour_map(spark, folder, k)
    return (
        G.components(nodes, V.mutual(knn))
        .join(G.pagerank(nodes, knn, rounds=rounds), "node")
        .join(D.project_pca(vectors).withColumnRenamed("vec_id", "node"), "node")
    )


def concept_map(spark: SparkSession, folder: str, band: Band = DOC_BAND, w: int = 5, k: int = 5, min_n: int = 3) -> DataFrame:
    """The map itself: concept, tf, df, component, community, rank and place of every concept.

    Concepts are the documents' most frequent within the band, related by how often they stand
    within `w` words of each other; every concept keeps its `k` heaviest edges.
    """
    units = doc_units(spark, folder)
    scratch = Scratch(spark, "concept-map")
    vocab = written_vocabulary(units, band)
    edges = R.prune_topk(R.cooccur_window(units, vocab, w), k=k, min_n=min_n).withColumnRenamed("n", "w")
    edges = scratch.table(edges, "edges")
    nodes = vocab.select(F.col("concept").alias("node"))
    parts = [
        G.components(nodes, edges).withColumnRenamed("comp", "component"),
        G.label_propagation(nodes, edges, rounds=5).withColumnRenamed("label", "community"),
        G.pagerank(nodes, R.both_ways(edges).select("src", "dst"), rounds=10).select("node", F.round("rank", 8).alias("rank")),
        D.layout_force(nodes, edges, rounds=5).select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
    ]
    out = vocab.select(F.col("concept").alias("node"), "tf", "df")
    for part in parts:
        out = out.join(part, "node")
    return scratch.table(out.withColumnRenamed("node", "concept"), "nodes")


def role_edges(spark: SparkSession, folder: str, w: int = 3) -> DataFrame:
    """Window co-occurrence per role: one map per kind of speaker."""
    units = turn_units(spark, folder)
    vocab = written_vocabulary(units, TURN_BAND)
    return R.cooccur_window(units, vocab, w, by=["role"])
