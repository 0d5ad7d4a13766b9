"""The registered queries in plain SQL, for the side-by-side check in another engine."""

from __future__ import annotations

from lodemap.functions.text import FOLD_FROM, FOLD_TO

ORACLES: dict[str, str] = {}


def sql(name: str, *ctes: str, final: str, recursive: bool = False) -> None:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ORACLES[name] = (head + ",\n".join(ctes) + "\n" if ctes else "") + final


def fold(col: str) -> str:
    return f"translate(lower({col}), '{FOLD_FROM}', '{FOLD_TO}')"


# --- shared parts --------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(text), '(\p{L}+)', 1)"
DOC_UNITS = f"units AS MATERIALIZED (SELECT doc_id, lang, source, {WORDS} AS toks FROM documents)"
TURN_UNITS = f"units AS MATERIALIZED (SELECT conv_id, turn, role, {WORDS} AS toks FROM conversations)"
DOC_TOK = "tok AS MATERIALIZED (SELECT doc_id, lang, source, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM units)"
TURN_TOK = "tok AS MATERIALIZED (SELECT conv_id, turn, role, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM units)"
DOC_STATS = "stats AS MATERIALIZED (SELECT tok AS concept, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1)"
TURN_STATS = "stats AS MATERIALIZED (SELECT tok AS concept, count(*) AS tf, count(DISTINCT (conv_id, turn)) AS df FROM tok GROUP BY 1)"


def vocab(table: str, top: int | None, min_df: int = 3, frac: float = 0.2) -> str:
    return f"""vocab AS MATERIALIZED (
  SELECT concept, tf, df, row_number() OVER (ORDER BY df DESC, concept) - 1 AS cid FROM stats
  WHERE df >= {min_df} AND df <= {frac} * (SELECT count(*) FROM {table})
  ORDER BY df DESC, concept {f"LIMIT {top}" if top else ""})"""


DOCS = (DOC_UNITS, DOC_TOK, DOC_STATS, vocab("documents", 500))
TURNS = (TURN_UNITS, TURN_TOK, TURN_STATS, vocab("conversations", 2000))
WHOLE_DOCS = (DOC_UNITS, DOC_TOK, DOC_STATS, vocab("documents", None))
WHOLE_TURNS = (TURN_UNITS, TURN_TOK, TURN_STATS, vocab("conversations", None))
DOC_MENTIONS = """ment AS MATERIALIZED (
  SELECT doc_id, lang, source, concept, count(*) AS tf FROM tok JOIN vocab ON tok = concept GROUP BY ALL)"""
TURN_MENTIONS = """ment AS MATERIALIZED (
  SELECT conv_id, turn, role, concept, count(*) AS tf FROM tok JOIN vocab ON tok = concept GROUP BY ALL)"""
DOC_BAG = """bag AS MATERIALIZED (
  SELECT a.concept AS src, b.concept AS dst, count(*) AS n
  FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.concept < b.concept GROUP BY 1, 2)"""


def near(key: str, w: int, by: str = "") -> str:
    """Window pairs of vocabulary tokens; `by` is a leading group column."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    group = f"a.{by} AS {by}, " if by else ""
    return f"""vtok AS MATERIALIZED (SELECT tok.* FROM tok JOIN vocab ON tok = concept),
near AS MATERIALIZED (
  SELECT {group}least(a.tok, b.tok) AS src, greatest(a.tok, b.tok) AS dst, count(*) AS n
  FROM (SELECT *, unnest(range(1, {w + 1})) AS off FROM vtok) a
  JOIN vtok b ON {same} AND b.pos = a.pos + a.off
  WHERE a.tok <> b.tok GROUP BY ALL)"""


KNN = (
    "vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)",
    """sims AS MATERIALIZED (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS sim
  FROM vec a JOIN vec b ON a.vec_id <> b.vec_id)""",
    """knn AS MATERIALIZED (
  SELECT src, dst, sim, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims) WHERE rank <= 5)""",
)
EDGES = """edges AS MATERIALIZED (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(round(sim * 1000000)::BIGINT) AS w FROM knn GROUP BY 1, 2)"""
ENDS = "ends AS MATERIALIZED (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"
GRAPH = (*KNN, EDGES, ENDS)
NODES = "nodes AS (SELECT vec_id AS node FROM embeddings)"

# --- sources and sinks ---------------------------------------------------------------

sql("turns_scan", final="""SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn
FROM conversations GROUP BY role""")
sql("documents_scan", final="""SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents WHERE lang = 'en' GROUP BY source""")
sql("vectors_scan", final="""SELECT vec_id, label, len(embedding) AS dim,
  round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings
WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0""")
sql("event_stream", final="""SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type""")
sql("relations_parsed", TURN_UNITS, TURN_TOK, final="""SELECT a.tok AS subject, 'before' AS relation, b.tok AS object,
  count(*) AS n, count(DISTINCT a.conv_id) AS conversations
FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1
WHERE a.role <> 'system' GROUP BY 1, 2, 3""")
sql("relations_rejected", final="SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'system'")
sql("map_written", *KNN, EDGES, final="""SELECT src, dst, w, 'near' AS map_id FROM edges
UNION ALL SELECT src, dst, w, 'strong' FROM edges WHERE w >= 400000""")
TOP_NODES = """best AS MATERIALIZED (
  SELECT src AS node, sum(w)::BIGINT AS score FROM ends GROUP BY 1 ORDER BY score DESC, node LIMIT 100)"""
sql("top_map_nodes", *GRAPH, TOP_NODES, final="SELECT node, score FROM best")
sql("top_map_edges", *GRAPH, TOP_NODES, final="""SELECT src, dst, w FROM edges
WHERE src IN (SELECT node FROM best) AND dst IN (SELECT node FROM best)""")

# --- concept mentions ----------------------------------------------------------------

sql("tokens", TURN_UNITS, TURN_TOK, final="SELECT conv_id, turn, role, pos, tok FROM tok")


def grams(size: int) -> str:
    """n-grams of the tokens by a chain of self-joins on the next position."""
    joins = "".join(
        f" JOIN tok t{k} ON t{k}.conv_id = t0.conv_id AND t{k}.turn = t0.turn AND t{k}.pos = t0.pos + {k}"
        for k in range(1, size)
    )
    text = " || ' ' || ".join(f"t{k}.tok" for k in range(size))
    return f"g{size} AS MATERIALIZED (SELECT t0.conv_id, t0.turn, t0.pos, {text} AS gram FROM tok t0{joins})"


sql("ngrams", TURN_UNITS, TURN_TOK, grams(3), final="SELECT gram, count(*) AS n, min(pos) AS first_pos FROM g3 GROUP BY gram")
sql("folded_labels", DOC_UNITS, DOC_TOK, DOC_STATS, final=f"""SELECT {fold('concept')} AS folded, count(*) AS n_forms,
  sum(tf)::BIGINT AS tf, first(concept ORDER BY tf DESC, concept) AS best_form FROM stats GROUP BY 1""")
sql("term_stats", DOC_UNITS, DOC_TOK, DOC_STATS, final="SELECT concept, tf, df FROM stats")
sql("term_stats_by_lang", DOC_UNITS, DOC_TOK, final="""SELECT lang, tok AS concept, count(*) AS tf, count(DISTINCT doc_id) AS df
FROM tok GROUP BY 1, 2""")
sql("vocabulary", *DOCS, final="SELECT concept, tf, df, cid FROM vocab")
sql("mentions", *WHOLE_DOCS, DOC_MENTIONS, final="SELECT doc_id, concept, tf FROM ment")
sql("stopwords_removed", TURN_UNITS, TURN_TOK, TURN_STATS, final="""SELECT conv_id, turn, count(*) AS left_over FROM tok
WHERE NOT EXISTS (SELECT 1 FROM stats WHERE concept = tok AND df > 0.1 * (SELECT count(*) FROM conversations))
GROUP BY 1, 2""")
sql("quality_semi", final="SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
sql("dedup_exact", final="SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
sql("dedup_near", DOC_UNITS, """sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE
  WHEN len(toks) >= 5 THEN list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' '))
  WHEN len(toks) > 0 THEN [array_to_string(toks, ' ')] ELSE [] END) AS g FROM units)""",
    "sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1)",
    """links AS MATERIALIZED (SELECT x, y FROM (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c))""",
    "reach AS (SELECT doc_id AS root, doc_id AS d FROM documents UNION SELECT r.root, l.y FROM reach r JOIN links l ON l.x = r.d)",
    final="""SELECT u.doc_id, coalesce(s.n, 0) AS n_shingles, g.group_id
FROM units u LEFT JOIN sizes s ON s.doc_id = u.doc_id JOIN (SELECT d, min(root) AS group_id FROM reach GROUP BY d) g ON g.d = u.doc_id""", recursive=True)
sql("tfidf", *WHOLE_TURNS, TURN_MENTIONS, final="""SELECT conv_id, turn, m.concept, m.tf,
  round(m.tf * ln(((SELECT count(*) FROM conversations)::DOUBLE + 1) / (v.df + 1)), 6) AS score
FROM ment m JOIN vocab v ON m.concept = v.concept""")
sql("top_concepts", *WHOLE_DOCS, DOC_MENTIONS, final="""SELECT source, concept, tf, rank FROM (
  SELECT source, concept, tf, row_number() OVER (PARTITION BY source ORDER BY tf DESC, concept) AS rank
  FROM (SELECT source, concept, sum(tf)::BIGINT AS tf FROM ment GROUP BY 1, 2)) WHERE rank <= 5""")


def g2(n: str, na: str, nb: str, total: str) -> str:
    def cell(k: str, row: str, col: str) -> str:
        return f"CASE WHEN {k} > 0 THEN ({k}) * ln(({k})::DOUBLE * {total} / (({row})::DOUBLE * ({col}))) ELSE 0.0 END"

    return "2 * (" + " + ".join([
        cell(n, na, nb),
        cell(f"({na} - {n})", na, f"{total} - {nb}"),
        cell(f"({nb} - {n})", f"{total} - {na}", nb),
        cell(f"({total} - {na} - {nb} + {n})", f"{total} - {na}", f"{total} - {nb}"),
    ]) + ")"


sql("collocations", DOC_UNITS, DOC_TOK,
    """bi AS MATERIALIZED (SELECT a.tok AS a, b.tok AS b, count(*) AS n
  FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1, 2)""",
    "l AS (SELECT a, sum(n)::BIGINT AS na FROM bi GROUP BY 1)",
    "r AS (SELECT b, sum(n)::BIGINT AS nb FROM bi GROUP BY 1)",
    "t AS (SELECT sum(n)::BIGINT AS total FROM bi)",
    final=f"""SELECT a, b, n, na, nb, round(ln(n::DOUBLE * total / (na::DOUBLE * nb)), 6) AS pmi,
  round({g2('n', 'na', 'nb', 'total')}, 6) AS g2
FROM bi JOIN l USING (a) JOIN r USING (b), t WHERE n >= 10""")
sql("dictionary_matches", TURN_UNITS, TURN_TOK, grams(1), grams(2), grams(3),
    *[f"top{s} AS (SELECT gram FROM g{s} GROUP BY gram ORDER BY count(*) DESC, gram LIMIT 100)" for s in (1, 2, 3)],
    """hits AS (""" + " UNION ALL ".join(
        f"SELECT conv_id, turn, pos, {s} AS n_words, {fold('gram')} AS concept FROM g{s} WHERE gram IN (SELECT gram FROM top{s})"
        for s in (1, 2, 3)) + ")",
    final="""SELECT conv_id, turn, pos, arg_max(concept, n_words) AS concept, max(n_words) AS n_words
FROM hits GROUP BY 1, 2, 3""")
sql("concept_cube", *WHOLE_DOCS, DOC_MENTIONS, final="""SELECT concept, lang, source, sum(tf)::BIGINT AS tf, count(*) AS units,
  grouping(lang) AS all_lang, grouping(source) AS all_source
FROM ment GROUP BY GROUPING SETS ((concept), (concept, lang), (concept, source), (concept, lang, source))""")

# --- relations -----------------------------------------------------------------------

sql("cooccur_bag", *DOCS, DOC_MENTIONS, DOC_BAG, final="SELECT src, dst, n FROM bag")
sql("cooccur_window", *DOCS, near("doc_id", 5), final="SELECT src, dst, n FROM near")
sql("assoc", *DOCS, DOC_MENTIONS, DOC_BAG, "total AS (SELECT count(*) AS t FROM documents)",
    "e AS (SELECT b.*, x.df AS na, y.df AS nb, t FROM bag b JOIN vocab x ON src = x.concept JOIN vocab y ON dst = y.concept, total)",
    final=f"""SELECT src, dst, n, na, nb,
  round(ln(n::DOUBLE * t / (na::DOUBLE * nb)), 6) AS pmi,
  round(CASE WHEN n < t THEN ln(n::DOUBLE * t / (na::DOUBLE * nb)) / -ln(n::DOUBLE / t) END, 6) AS npmi,
  round(n::DOUBLE * t / (na::DOUBLE * nb), 6) AS lift,
  round(n::DOUBLE / (na + nb - n), 6) AS jaccard,
  round(2 * n::DOUBLE / (na + nb), 6) AS dice,
  round({g2('n', 'na', 'nb', 't')}, 6) AS g2
FROM e""")

ARCS = (
    *TURNS, TURN_MENTIONS,
    """pairs AS MATERIALIZED (
  SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""",
    "cues AS MATERIALIZED (SELECT p.conv_id, p.turn, concept FROM pairs p JOIN ment m ON m.conv_id = p.conv_id AND m.turn = p.turn)",
    "resps AS MATERIALIZED (SELECT p.conv_id, p.turn, concept FROM pairs p JOIN ment m ON m.conv_id = p.conv_id AND m.turn = p.turn + 1)",
    """arcs AS MATERIALIZED (
  SELECT c.concept AS cue, r.concept AS resp, count(*) AS n
  FROM cues c JOIN resps r ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY 1, 2 HAVING count(*) >= 3)""",
    "cn AS (SELECT concept, count(*) AS na FROM cues GROUP BY 1)",
    "rn AS (SELECT concept, count(*) AS nb FROM resps GROUP BY 1)",
    """scored AS MATERIALIZED (
  SELECT cue, resp, n, round(n::DOUBLE / na, 6) AS conf,
    round(n::DOUBLE * (SELECT count(*) FROM pairs) / (na::DOUBLE * nb), 6) AS lift
  FROM arcs JOIN cn ON cue = cn.concept JOIN rn ON resp = rn.concept)""",
)
sql("cue_response", *ARCS, final="SELECT * FROM scored")
sql("pruned_arcs", *ARCS, final="""SELECT cue, resp, n, conf, lift FROM (
  SELECT *, row_number() OVER (PARTITION BY cue ORDER BY n DESC, resp) AS r1,
    row_number() OVER (PARTITION BY resp ORDER BY n DESC, cue) AS r2 FROM scored) WHERE r1 <= 5 OR r2 <= 5""")
sql("lagged_arcs", *TURNS, TURN_MENTIONS, final="""SELECT lag::INT AS lag, a.concept AS cue, b.concept AS resp, count(*) AS n
FROM (SELECT *, unnest(range(1, 4)) AS lag FROM ment) a
JOIN ment b ON a.conv_id = b.conv_id AND b.turn = a.turn + lag GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
sql("subsumes", *DOCS, DOC_MENTIONS, DOC_BAG,
    "both_ends AS (SELECT src AS parent, dst AS child, n FROM bag UNION ALL SELECT dst, src, n FROM bag)",
    final="""SELECT parent, child, n, round(n / c.df, 6) AS p_parent, round(n / p.df, 6) AS p_child
FROM both_ends JOIN vocab p ON parent = p.concept JOIN vocab c ON child = c.concept
WHERE n / c.df >= 0.6 AND n / p.df < n / c.df""")
sql("knn_exact", *KNN, final="SELECT src, dst, sim, rank FROM knn")
sql("similar_pairs",
    "vec AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS rep FROM embeddings GROUP BY 1)",
    final="""SELECT a.rep AS src, b.rep AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS sim, 'similar' AS kind
FROM vec a JOIN vec b ON a.rep < b.rep WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.4
UNION ALL SELECT rep, vec_id, 1.0, 'copy' FROM embeddings JOIN vec ON embedding::DOUBLE[] = v WHERE vec_id <> rep""")
MUTUAL = "mutual AS MATERIALIZED (SELECT a.src, a.dst, a.sim FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"
sql("mutual_neighbours", *KNN, MUTUAL, final="SELECT src, dst, sim FROM mutual")
sql("pruned_edges", *DOCS, near("doc_id", 5),
    "ends AS (SELECT src, dst, n FROM near WHERE n >= 3 UNION ALL SELECT dst, src, n FROM near WHERE n >= 3)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM ends)",
    final="SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, n FROM ranked WHERE r <= 5")
sql("backbone", *DOCS, near("doc_id", 5),
    """nd AS MATERIALIZED (SELECT src AS node, count(*) AS deg, sum(n)::BIGINT AS s
  FROM (SELECT src, n FROM near UNION ALL SELECT dst, n FROM near) GROUP BY 1)""",
    """scored AS (SELECT e.src, e.dst, n AS w,
    round(least(pow(1 - n / a.s, a.deg - 1), pow(1 - n / b.s, b.deg - 1)), 6) AS p
  FROM near e JOIN nd a ON e.src = a.node JOIN nd b ON e.dst = b.node)""",
    final="SELECT src, dst, w, p FROM scored WHERE p < 0.05")
sql("merged_edges", *DOCS, DOC_MENTIONS, DOC_BAG, near("doc_id", 5), final="""SELECT src, dst, round(sum(w), 6) AS w, count(*) AS kinds FROM (
  SELECT src, dst, n::DOUBLE AS w FROM near UNION ALL SELECT src, dst, n * 0.5::DOUBLE FROM bag) GROUP BY 1, 2""")

sql("knn_recall", final="SELECT count(*) * 5 AS n_exact, true AS enough FROM embeddings")

# --- graph analysis ------------------------------------------------------------------

sql("degrees", *GRAPH, final="SELECT src AS node, count(*) AS deg, sum(w)::BIGINT AS strength FROM ends GROUP BY 1")
sql("components", *KNN, MUTUAL, NODES,
    "both_ends AS (SELECT src, dst FROM mutual UNION ALL SELECT dst, src FROM mutual)",
    "reach AS (SELECT node, node AS seen FROM nodes UNION SELECT r.node, b.dst FROM reach r JOIN both_ends b ON r.seen = b.src)",
    final="SELECT node, min(seen) AS comp FROM reach GROUP BY node", recursive=True)

ROUNDS = ["r0 AS (SELECT vec_id AS node, 1.0::DOUBLE / (SELECT count(*) FROM embeddings) AS rank FROM embeddings)"]
for i in range(1, 11):
    ROUNDS.append(f"""r{i} AS MATERIALIZED (
  SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(m.m, 0) + d.lost / c.n) AS rank
  FROM nodes n LEFT JOIN (SELECT a.dst, sum(r.rank / o.o) AS m FROM knn a JOIN r{i - 1} r ON r.node = a.src
    JOIN outs o ON o.src = a.src GROUP BY 1) m ON m.dst = n.node,
    (SELECT count(*) AS n FROM nodes) c,
    (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM outs)) d)""")
RANK_ROUNDS = ROUNDS
sql("pagerank", *KNN, NODES, "outs AS MATERIALIZED (SELECT src, count(*) AS o FROM knn GROUP BY 1)", *ROUNDS,
    final="SELECT node, round(rank, 8) AS rank FROM r10")

ROUNDS = ["l0 AS (SELECT vec_id AS node, vec_id AS label FROM embeddings)"]
for i in range(1, 6):
    ROUNDS.append(f"""l{i} AS MATERIALIZED (
  SELECT p.node, coalesce(b.label, p.label) AS label FROM l{i - 1} p LEFT JOIN (
    SELECT src, first(label ORDER BY s DESC, label) AS label FROM (
      SELECT e.src, l.label, sum(e.w) AS s FROM ends e JOIN l{i - 1} l ON l.node = e.dst GROUP BY 1, 2) GROUP BY 1) b
  ON b.src = p.node)""")
LABEL_ROUNDS = ROUNDS
sql("label_propagation", *GRAPH, *ROUNDS, final="SELECT node, label FROM l5")

sql("triangles", *GRAPH, NODES,
    "tri AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst)",
    "per AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY 1)",
    "dg AS (SELECT src AS node, count(*) AS deg FROM ends GROUP BY 1)",
    final="""SELECT node, coalesce(deg, 0) AS deg, coalesce(t, 0) AS triangles,
  CASE WHEN coalesce(deg, 0) > 1 THEN round(2.0::DOUBLE * coalesce(t, 0) / (deg * (deg - 1)), 6) ELSE 0.0 END AS clustering
FROM nodes LEFT JOIN dg USING (node) LEFT JOIN per USING (node)""")


def hops(k: int) -> list[str]:
    out = ["h0 AS (SELECT min(vec_id) AS node, 0 AS hop, NULL::BIGINT AS pred FROM embeddings)", "s0 AS (SELECT * FROM h0)"]
    for i in range(1, k + 1):
        out.append(f"""h{i} AS MATERIALIZED (SELECT e.dst AS node, {i} AS hop, min(e.src) AS pred
  FROM ends e JOIN h{i - 1} h ON h.node = e.src WHERE e.dst NOT IN (SELECT node FROM s{i - 1}) GROUP BY 1)""")
        out.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM h{i})")
    return out


sql("k_hop", *GRAPH, *hops(3), final="SELECT node, hop FROM s3")
sql("paths", *GRAPH, *hops(6), final="SELECT node, hop, pred FROM s6")
LABELLED = """le AS MATERIALIZED (SELECT a.label AS la, b.label AS lb, w FROM edges
  JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst)"""
sql("modularity", *GRAPH, LABELLED,
    "d AS (SELECT label, sum(w)::DOUBLE AS d FROM (SELECT la AS label, w FROM le UNION ALL SELECT lb, w FROM le) GROUP BY 1)",
    final="""SELECT count(*) AS n_labels, round(
  (SELECT coalesce(sum(w), 0) FROM le WHERE la = lb)::DOUBLE / (sum(d) / 2) - sum(d * d) / (sum(d) * sum(d)), 6) AS q FROM d""")
sql("quotient", *GRAPH, LABELLED, final="""SELECT least(la, lb) AS src, greatest(la, lb) AS dst, count(*) AS n, sum(w)::BIGINT AS w
FROM le GROUP BY 1, 2""")
CORE_ROUNDS = 15
ROUNDS = [MUTUAL, "k0 AS (SELECT src, dst, sim FROM mutual)"]
for i in range(1, CORE_ROUNDS + 1):
    ROUNDS.append(f"d{i} AS MATERIALIZED (SELECT node FROM (SELECT src AS node FROM k{i - 1} UNION ALL SELECT dst FROM k{i - 1}) GROUP BY 1 HAVING count(*) >= 3)")
    ROUNDS.append(f"k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} WHERE src IN (SELECT node FROM d{i}) AND dst IN (SELECT node FROM d{i}))")
sql("k_core", *KNN, *ROUNDS, final=f"SELECT src, dst, sim FROM k{CORE_ROUNDS}")

# Kruskal's algorithm, one edge per step, with the component of every node in a list.
sql("spanning_forest", *GRAPH,
    "ids AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings)",
    """ordered AS MATERIALIZED (
  SELECT e.src, e.dst, e.w, a.p AS pa, b.p AS pb, row_number() OVER (ORDER BY w DESC, e.src, e.dst) AS i
  FROM edges e JOIN ids a ON a.vec_id = e.src JOIN ids b ON b.vec_id = e.dst)""",
    """steps AS (
  SELECT 0::BIGINT AS i, (SELECT list(p ORDER BY p) FROM ids) AS comp, false AS kept
  UNION ALL
  SELECT o.i, CASE WHEN comp[o.pa] <> comp[o.pb]
      THEN list_transform(comp, lambda c: CASE WHEN c = comp[o.pb] THEN comp[o.pa] ELSE c END) ELSE comp END,
    comp[o.pa] <> comp[o.pb]
  FROM steps JOIN ordered o ON o.i = steps.i + 1)""",
    final="SELECT src, dst, w FROM steps JOIN ordered USING (i) WHERE kept", recursive=True)

# --- groups --------------------------------------------------------------------------

sql("cluster_profile",
    "vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings)",
    "dims AS (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec)",
    "cen AS MATERIALIZED (SELECT cluster, list(c ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS c FROM dims GROUP BY 1, 2) GROUP BY 1)",
    "sim AS (SELECT cluster, vec_id, round(list_cosine_similarity(v, c), 6) AS s, c FROM vec JOIN cen USING (cluster))",
    final="""SELECT cluster, count(*) AS size, round(sqrt(list_sum(list_transform(first(c), lambda x: x * x))), 6) AS centroid_norm,
  first(vec_id ORDER BY s DESC, vec_id) AS medoid, max(s) AS medoid_sim FROM sim GROUP BY cluster""")
sql("cluster_names", *WHOLE_DOCS, DOC_MENTIONS,
    "per AS (SELECT lang, concept, sum(tf)::BIGINT AS tf FROM ment GROUP BY 1, 2)",
    "tot AS (SELECT concept, sum(tf)::BIGINT AS all_tf FROM per GROUP BY 1)",
    "mean AS (SELECT sum(tf)::DOUBLE / count(DISTINCT lang) AS a FROM per)",
    "sc AS (SELECT lang, concept, tf, round(tf * ln(1 + a / all_tf), 6) AS score FROM per JOIN tot USING (concept), mean)",
    final="""SELECT * FROM (SELECT lang, concept, tf, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, concept) AS rank FROM sc)
WHERE rank <= 10""")
sql("agreement",
    "p AS (SELECT label AS a, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS b FROM embeddings)",
    "c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)",
    "ra AS (SELECT sum(n) AS n, sum(best) AS best, sum(same) AS same, sum(n * (n - 1)) AS pa FROM (SELECT a, sum(n) AS n, max(n) AS best, sum(n * (n - 1)) AS same FROM c GROUP BY a))",
    "cb AS (SELECT sum(n * (n - 1)) AS pb FROM (SELECT b, sum(n) AS n FROM c GROUP BY b))",
    final="""SELECT n::BIGINT AS n, round(best::DOUBLE / n, 6) AS purity,
  round((n * (n - 1) + 2 * same - pa - pb)::DOUBLE / (n * (n - 1)), 6) AS rand FROM ra, cb""")

# --- display -------------------------------------------------------------------------

PLACED = """placed AS MATERIALIZED (
  SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, round(embedding[3]::DOUBLE, 6) AS score FROM embeddings)"""


def cell(axis: str, z: str) -> str:
    return f"(CASE WHEN {axis} = 1.0 THEN (1 << {z}) - 1 ELSE floor(({axis} + 1.0) / 2.0 * (1 << {z})) END)::INT"


sql("tiles", PLACED,
    f"zoomed AS (SELECT z::INT AS z, {cell('x', 'z::INT')} AS tx, {cell('y', 'z::INT')} AS ty, node, score FROM (SELECT *, unnest(range(0, 6)) AS z FROM placed))",
    final="""SELECT z, tx, ty, n, rank, node FROM (SELECT z, tx, ty, node, count(*) OVER (PARTITION BY z, tx, ty) AS n,
  row_number() OVER (PARTITION BY z, tx, ty ORDER BY score DESC, node) AS rank FROM zoomed) WHERE rank <= 3""")
sql("viewport", PLACED, final="""SELECT node, round(x, 6) AS x, round(y, 6) AS y, score FROM placed
WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.1 AND 0.2 ORDER BY score DESC, node LIMIT 25""")
sql("bundle_edges", *KNN, EDGES, PLACED,
    f"cells AS (SELECT node, {cell('x', '4')} AS tx, {cell('y', '4')} AS ty FROM placed)",
    """p AS (SELECT CASE WHEN (a.tx, a.ty) <= (b.tx, b.ty) THEN a.tx ELSE b.tx END AS ax,
    CASE WHEN (a.tx, a.ty) <= (b.tx, b.ty) THEN a.ty ELSE b.ty END AS ay,
    CASE WHEN (a.tx, a.ty) <= (b.tx, b.ty) THEN b.tx ELSE a.tx END AS bx,
    CASE WHEN (a.tx, a.ty) <= (b.tx, b.ty) THEN b.ty ELSE a.ty END AS b_y, w
  FROM edges JOIN cells a ON a.node = src JOIN cells b ON b.node = dst)""",
    final='SELECT ax, ay, bx, b_y AS "by", count(*) AS n, sum(w)::BIGINT AS w FROM p GROUP BY 1, 2, 3, 4')



def start(axis: int) -> str:
    return f"('0x' || substr(md5(vec_id || '/1/{axis}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0"


ROUNDS = [
    f"p0 AS MATERIALIZED (SELECT vec_id AS node, {start(0)} AS x, {start(1)} AS y FROM embeddings)",
    "c AS (SELECT pow(count(*), -0.5) AS d, (SELECT max(w) FROM edges)::DOUBLE AS top FROM embeddings)",
]
for i in range(1, 6):
    step = 0.1 * (1 - (i - 1) / 5)
    ROUNDS.append(f"""cell{i} AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(x) AS x, avg(y) AS y FROM p{i - 1} GROUP BY floor(x * 8), floor(y * 8))""")
    ROUNDS.append(f"""pull{i} AS MATERIALIZED (SELECT node, sum(fx) AS fx, sum(fy) AS fy FROM (
    SELECT unnest([src, dst]) AS node, unnest([dx * size, -dx * size]) AS fx, unnest([dy * size, -dy * size]) AS fy FROM (
      SELECT src, dst, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * w / top / d AS size
      FROM edges JOIN p{i - 1} a ON a.node = src JOIN p{i - 1} b ON b.node = dst, c)) GROUP BY node)""")
    ROUNDS.append(f"""push{i} AS MATERIALIZED (SELECT node,
    sum(k.n * (p.x - k.x) * d * d / ((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) + d * d)) AS fx,
    sum(k.n * (p.y - k.y) * d * d / ((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) + d * d)) AS fy
  FROM p{i - 1} p, cell{i} k, c GROUP BY node)""")
    ROUNDS.append(f"""f{i} AS MATERIALIZED (SELECT node, x, y, coalesce(l.fx, 0) + h.fx AS fx, coalesce(l.fy, 0) + h.fy AS fy
  FROM p{i - 1} JOIN push{i} h USING (node) LEFT JOIN pull{i} l USING (node))""")
    move = f"CASE WHEN sqrt(fx * fx + fy * fy) > 0 THEN least(sqrt(fx * fx + fy * fy), {step!r}::DOUBLE) / sqrt(fx * fx + fy * fy) ELSE 0.0 END"
    ROUNDS.append(f"""p{i} AS MATERIALIZED (SELECT node, round(greatest(0.0, least(0.999999, x + fx * {move})), 9) AS x,
    round(greatest(0.0, least(0.999999, y + fy * {move})), 9) AS y FROM f{i})""")
LAYOUT_ROUNDS = ROUNDS
sql("layout_force", *GRAPH, *ROUNDS, final="SELECT node, round(x, 4) AS x, round(y, 4) AS y FROM p5")


def of_concepts(rounds: list[str]) -> list[str]:
    """Rounds over vectors as rounds over the concepts of the vocabulary."""
    return [r.replace("vec_id AS label", "concept AS label").replace("vec_id", "concept").replace("FROM embeddings", "FROM vocab") for r in rounds]


CONCEPT_MAP = (
    *DOCS, near("doc_id", 5),
    "both_near AS (SELECT src, dst, n FROM near WHERE n >= 3 UNION ALL SELECT dst, src, n FROM near WHERE n >= 3)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM both_near)",
    "edges AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, n AS w FROM ranked WHERE r <= 5)",
    ENDS, "knn AS MATERIALIZED (SELECT src, dst FROM ends)", "nodes AS (SELECT concept AS node FROM vocab)",
    "outs AS MATERIALIZED (SELECT src, count(*) AS o FROM knn GROUP BY 1)",
    *of_concepts(RANK_ROUNDS), *of_concepts(LABEL_ROUNDS), *of_concepts(LAYOUT_ROUNDS),
    "reach AS (SELECT node, node AS seen FROM nodes UNION SELECT a.node, b.dst FROM reach a JOIN ends b ON a.seen = b.src)",
    "comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)",
    """cmap AS MATERIALIZED (SELECT concept, tf, df, component, l5.label AS community, round(r10.rank, 8) AS rank, round(p5.x, 4) AS x, round(p5.y, 4) AS y
  FROM vocab JOIN comps ON comps.node = concept JOIN l5 ON l5.node = concept JOIN r10 ON r10.node = concept JOIN p5 ON p5.node = concept)""",
)
sql("concept_map", *CONCEPT_MAP, final="SELECT * FROM cmap", recursive=True)
sql("concept_tiles", *CONCEPT_MAP,
    """zoomed AS (SELECT z::INT AS z, CASE WHEN x = 1.0 THEN (1 << z::INT) - 1 ELSE floor(x * (1 << z::INT))::INT END AS tx,
  CASE WHEN y = 1.0 THEN (1 << z::INT) - 1 ELSE floor(y * (1 << z::INT))::INT END AS ty, concept AS node, rank AS score
  FROM (SELECT *, unnest(range(0, 5)) AS z FROM cmap))""",
    final="""SELECT z, tx, ty, n, rank, node FROM (SELECT z, tx, ty, node, count(*) OVER (PARTITION BY z, tx, ty) AS n,
  row_number() OVER (PARTITION BY z, tx, ty ORDER BY score DESC, node) AS rank FROM zoomed) WHERE rank <= 3""", recursive=True)

# --- comparing maps ------------------------------------------------------------------

TWO_MAPS = (
    *TURNS, near("conv_id, turn", 3, by="role"),
    "ea AS (SELECT src, dst, n FROM near WHERE role = 'user')",
    "eb AS (SELECT src, dst, n FROM near WHERE role = 'assistant')",
)
sql("map_diff", *TWO_MAPS, final="""SELECT coalesce(ea.src, eb.src) AS src, coalesce(ea.dst, eb.dst) AS dst,
  CASE WHEN ea.n IS NULL THEN 'added' WHEN eb.n IS NULL THEN 'removed' WHEN ea.n = eb.n THEN 'same' ELSE 'changed' END AS status,
  coalesce(eb.n, 0) - coalesce(ea.n, 0) AS delta
FROM ea FULL JOIN eb ON ea.src = eb.src AND ea.dst = eb.dst""")
ROLE_STATS = "rs AS MATERIALIZED (SELECT role, tok AS concept, count(*) AS tf, count(DISTINCT (conv_id, turn)) AS df FROM tok GROUP BY 1, 2)"
sql("rank_shift", TURN_UNITS, TURN_TOK, ROLE_STATS,
    "kept AS (SELECT role, concept, df FROM rs)",
    "rk AS (SELECT role, concept, dense_rank() OVER (PARTITION BY role ORDER BY df DESC) AS rank FROM kept)",
    "ra AS (SELECT concept, dense_rank() OVER (ORDER BY df DESC) AS rank_all FROM (SELECT concept, sum(df) AS df FROM kept GROUP BY 1))",
    final="SELECT role, concept, rank, rank_all, rank_all - rank AS shift FROM rk JOIN ra USING (concept)")
sql("shared_concepts", TURN_UNITS, TURN_TOK, ROLE_STATS,
    final="SELECT concept FROM rs WHERE role = 'user' INTERSECT SELECT concept FROM rs WHERE role = 'assistant'")
sql("only_in_replies", TURN_UNITS, TURN_TOK, ROLE_STATS,
    final="SELECT concept FROM rs WHERE role = 'assistant' EXCEPT SELECT concept FROM rs WHERE role = 'user'")
sql("neighbour_overlap", *TWO_MAPS,
    "marks AS (SELECT src, dst, 1 AS m FROM ea UNION ALL SELECT dst, src, 1 FROM ea UNION ALL SELECT src, dst, 2 FROM eb UNION ALL SELECT dst, src, 2 FROM eb)",
    "per AS (SELECT src, dst, count(DISTINCT m) AS c FROM marks GROUP BY 1, 2)",
    final="""SELECT src AS concept, count(*) FILTER (c = 2) AS n_both, count(*) AS n_either,
  round(count(*) FILTER (c = 2) / count(*), 6) AS jaccard FROM per GROUP BY 1""")
sql("drift", "d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)",
    final="""SELECT event_type, day, n, n - lag(n) OVER w AS change,
  round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")

# --- streaming: closed windows only --------------------------------------------------

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


sql("trend_tumbling", "e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS s FROM events)",
    final=f"""SELECT {stamp('s')} AS start, {stamp('s + INTERVAL 6 HOUR')} AS "end", event_type AS concept, count(*) AS n, round(sum(value), 2) AS value
FROM e WHERE s + INTERVAL 6 HOUR <= {CLOSED} GROUP BY s, event_type""")
sql("trend_sliding", """e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(6 * unnest(range(0, 4))) AS s FROM events)""",
    final=f"""SELECT {stamp('s')} AS start, {stamp('s + INTERVAL 24 HOUR')} AS "end", event_type AS concept, count(*) AS n, round(sum(value), 2) AS value
FROM e WHERE s + INTERVAL 24 HOUR <= {CLOSED} GROUP BY s, event_type""")
sql("sessions",
    "f AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)",
    "g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM f)",
    "s AS (SELECT user_id, sid, min(ts) AS a, max(ts) + INTERVAL 3 HOUR AS b, count(*) AS n, count(DISTINCT event_type) AS concepts FROM g GROUP BY 1, 2)",
    final=f"""SELECT user_id, {stamp('a')} AS start, {stamp('b')} AS "end", n, concepts FROM s WHERE b <= {CLOSED}""")
sql("dedup_stream", final="SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
sql("tag_stream", f"e AS (SELECT event_type, {K} AS k FROM events)", final="""SELECT
  CASE WHEN k < 90 THEN 'band' || (k // 10) END AS concept, event_type, count(*) AS n FROM e GROUP BY 1, 2""")
sql("tagged_trend",
    f"e AS (SELECT *, {K} AS k, time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '2000-01-01') AS s FROM events)",
    final=f"""SELECT {stamp('s')} AS start, {stamp('s + INTERVAL 24 HOUR')} AS "end", CASE WHEN k < 90 THEN 'band' || (k // 10) END AS concept,
  count(*) AS n, round(sum(value), 2) AS value
FROM e WHERE s + INTERVAL 24 HOUR <= {CLOSED} GROUP BY 1, 2, 3""")
sql("upsert_edges", final=f"SELECT event_type AS src, 'k' || {K} AS dst, count(*) AS n FROM events GROUP BY 1, 2")
LATE = "2 * epoch_us(ts) < (SELECT epoch_us(min(ts)) + epoch_us(max(ts)) FROM events)"
sql("late_rows", final=f"""SELECT count(*) AS n_input,
  count(*) FILTER (ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) AS n_dropped FROM events WHERE {LATE}""")
