"""Queries of the graph, of links between texts, of fusion and of whole retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fusion, graph, lexical, linking
from ..operators.containment import only
from ..plans.engine import Engine
from ..sources import tables
from ..sources.scratch import kept
from . import sql
from .lexical import R6


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = tables.trade_edges(spark, d)
    return edges, graph.derive_nodes(edges, tables.trade_labels(spark, d))


def derive_nodes(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d)[1]


DERIVE_NODES = f"WITH {sql.TRADE} SELECT node_id, label, kind, pos FROM nodes"


def labelled_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.labelled(*trade(spark, d)).select("pos", "s_label", "p", "o_label")


LABELLED_EDGES = f"WITH {sql.TRADE} SELECT e.pos, coalesce(a.label, e.s) AS s_label, e.p, coalesce(b.label, e.o) AS o_label FROM edges e LEFT JOIN nodes a ON a.node_id = e.s LEFT JOIN nodes b ON b.node_id = e.o"


def nations(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"))


def neighbor_ids(direction: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return graph.neighbor_ids(tables.trade_edges(spark, d), nations(spark, d), 20, direction).select("node", "other", "pos")

    ways = {"out": "SELECT s AS node, o AS other, pos FROM edges WHERE s <> o", "in": "SELECT o AS node, s AS other, pos FROM edges WHERE s <> o"}
    body = ways.get(direction) or f"{ways['out']} UNION ALL {ways['in']}"
    return run, f"""WITH {sql.TRADE}, ways AS ({body}), near AS (SELECT node, other, min(pos) AS pos FROM ways WHERE node LIKE 'n:%' GROUP BY ALL)
SELECT node, other, pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos, other) AS r FROM near) WHERE r <= 20"""


def neighbors_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(*trade(spark, d), nations(spark, d), 1, 100).select("seed", "pos", "s_label", "p", "o_label")


NEIGHBORS = f"""WITH {sql.TRADE}, touch AS (SELECT s AS seed, pos FROM edges WHERE s LIKE 'n:%' UNION SELECT o, pos FROM edges WHERE o LIKE 'n:%'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS r FROM touch) WHERE r <= 100)
SELECT seed, e.pos, coalesce(a.label, e.s) AS s_label, e.p, coalesce(b.label, e.o) AS o_label
FROM first JOIN edges e USING (pos) LEFT JOIN nodes a ON a.node_id = e.s LEFT JOIN nodes b ON b.node_id = e.o"""


def bfs_2hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = tables.read(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.reach(tables.trade_edges(spark, d), seeds, 2).select("seed", "node", F.col("hop").cast("int").alias("hop"))


BFS = f"""WITH {sql.TRADE}, ways AS (SELECT s AS a, o AS b FROM edges WHERE s <> o UNION SELECT o, s FROM edges WHERE s <> o),
h0 AS (SELECT 'r:' || r_regionkey AS seed, 'r:' || r_regionkey AS node, 0 AS hop FROM region),
h1 AS (SELECT DISTINCT seed, b AS node, 1 AS hop FROM h0 JOIN ways ON a = node),
h2 AS (SELECT DISTINCT seed, b AS node, 2 AS hop FROM h1 JOIN ways ON a = node)
SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL"""


def class_instances(spark: SparkSession, d: str) -> DataFrame:
    return graph.class_instances(*trade(spark, d), 100).select("class_id", "instance_id", "label", "r")


CLASS_INSTANCES = f"""WITH {sql.TRADE}, m AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY pos) AS r FROM edges WHERE p = 'instanceOf')
SELECT o AS class_id, s AS instance_id, label, CAST(r AS INTEGER) AS r FROM m JOIN nodes ON node_id = s WHERE r <= 100"""


def count_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.class_counts(tables.trade_edges(spark, d))


COUNT_CLASS = f"WITH {sql.TRADE} SELECT o AS class_id, count(*) AS n FROM edges WHERE p = 'instanceOf' GROUP BY o"


def class_seed_string(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = trade(spark, d)
    hits = nodes.where("kind = 'class'").select(F.col("pos").alias("query_id"), "node_id", "label", "kind", F.lit(1).alias("rank"))
    return graph.class_seed(edges, nodes, hits)


CLASS_SEED = f"""WITH {sql.TRADE}, m AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY pos) AS r FROM edges WHERE p = 'instanceOf'),
l AS (SELECT o, list(label ORDER BY r) AS names FROM m JOIN nodes ON node_id = s WHERE r <= 1000 GROUP BY o HAVING count(*) >= 2)
SELECT pos AS query_id, '[CLASS ''' || label || ''' has ' || len(names) || ' instances: ' || array_to_string(list_slice(names, 1, 150), ' | ')
  || CASE WHEN len(names) > 150 THEN ' (+' || (len(names) - 150) || ' more)' ELSE '' END || '. List all only' || ' if asked to enumerate/count; ' || 'otherwise pick' || ' the relevant ones.]' AS class_seed
FROM l JOIN nodes ON node_id = o WHERE kind = 'class'"""


def label_search(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = tables.chunk_graph(spark, d)
    return graph.search_labels(nodes, tables.questions(spark, d)).select("query_id", "node_id", "rank", R6("score").alias("score"))


LABELS = f"""lab AS (SELECT doc_id AS slot, {sql.tok('substr(text, 1, 80)')} AS b FROM documents WHERE text <> ''),
lstats AS (SELECT count(*) AS n, avg(len(b)) AS avg_b FROM lab), lbody AS (SELECT slot, term, count(*) AS tf FROM (SELECT slot, unnest(b) AS term FROM lab) GROUP BY ALL),
ldf AS (SELECT term, count(*) AS df FROM lbody GROUP BY term),
lscores AS (SELECT query_id, slot, round(sum(qtf * {sql.idf('df')} * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * greatest(len(b), 1) / avg_b))), 9) AS score
  FROM terms JOIN lbody USING (term) JOIN ldf USING (term) JOIN lab USING (slot) CROSS JOIN lstats GROUP BY ALL)"""
LABEL_SEARCH = f"WITH {sql.QUESTIONS}, {sql.TERMS}, {LABELS}, {sql.top('lscores', 30)} SELECT query_id, 'd' || slot AS node_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM pool"


def named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents titled by a benchmark passage's first words where they hold that passage, and the questions."""
    b = tables.read(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"))
    titled = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chunk_id"), "title", F.lit("").alias("text"))
    docs = tables.chunks(spark, d).select("chunk_id", F.lit("").alias("title"), "text")
    return titled.unionByName(docs), b


def title_links(spark: SparkSession, d: str) -> DataFrame:
    return linking.title_links(named(spark, d)[0])


NAMED = f"""named AS (SELECT 'b' || item_id AS target, {sql.tok("array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')")} AS t FROM benchmark),
cuts AS (SELECT target, t, list_filter(range(3, len(t) + 1), lambda i: t[i] IN ('from', 'in', 'of')) AS spot FROM named WHERE len(t) >= 2),
names AS (SELECT DISTINCT target, t AS a FROM cuts UNION SELECT target, list_slice(t, 1, spot[1] - 1) FROM cuts WHERE len(spot) > 0),
uniq AS (SELECT array_to_string(a, ' ') AS alias, len(a) AS width, min(target) AS target FROM names GROUP BY ALL HAVING count(DISTINCT target) = 1)"""
TITLE_LINKS = f"""WITH {NAMED}, txt AS (SELECT 'd' || doc_id AS s, ' ' || array_to_string({sql.tok('text')}, ' ') || ' ' AS x FROM documents)
SELECT s, 'references' AS p, target AS o FROM txt JOIN uniq ON contains(x, ' ' || alias || ' ') GROUP BY ALL"""


def ambiguous_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = text.with_title_aliases(tables.chunks(spark, d).select("chunk_id", "title"), "title", "names").select("chunk_id", F.explode("names").alias("a"))
    return rows.groupBy(F.array_join("a", " ").alias("alias")).agg(F.count_distinct("chunk_id").alias("owners")).where("owners > 1")


AMBIGUOUS = f"""WITH x AS (SELECT doc_id, {sql.tok("trim(regexp_replace(substr(text, 1, 80), '\\s*\\([^()]*\\)\\s*$', ''))")} AS t FROM documents WHERE text <> ''),
y AS (SELECT doc_id, t, list_filter(range(3, len(t) + 1), lambda i: t[i] IN ('from', 'in', 'of')) AS spot FROM x WHERE len(t) >= 2),
z AS (SELECT doc_id, array_to_string(t, ' ') AS alias FROM y UNION SELECT doc_id, array_to_string(list_slice(t, 1, spot[1] - 1), ' ') FROM y WHERE len(spot) > 0)
SELECT alias, count(DISTINCT doc_id) AS owners FROM z GROUP BY alias HAVING count(DISTINCT doc_id) > 1"""


def title_query_match(spark: SparkSession, d: str) -> DataFrame:
    titles = named(spark, d)[1].select("item_id", "title")
    rows = text.with_title_match(titles.join(tables.questions(spark, d)), "question", "title", "m").where("m IS NOT NULL")
    return rows.select("query_id", "item_id", F.col("m.affinity").alias("affinity"), F.col("m.offset").alias("offset"))


TITLE_MATCH = f"""WITH {NAMED}, ask AS (SELECT item_id AS query_id, {sql.tok('text')} AS q FROM benchmark),
places AS (SELECT query_id, CAST(substr(target, 2) AS BIGINT) AS item_id, a, q, unnest(range(0, len(q) - len(a) + 1)) AS o FROM ask CROSS JOIN names WHERE len(q) >= len(a)),
wrong AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] <> q[o + i]) AS w FROM places),
hits AS (SELECT query_id, item_id, o, CASE WHEN len(w) = 0 THEN 1.0 WHEN len(a) >= 2 AND len(w) = 1 AND levenshtein(a[w[1]], q[o + w[1]]) <= 1 THEN 0.95 END AS aff FROM wrong)
SELECT query_id, item_id, CAST(aff AS DOUBLE) AS affinity, CAST(o AS INTEGER) AS "offset"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY aff DESC, o) AS r FROM hits WHERE aff IS NOT NULL) WHERE r = 1"""


def engine(spark: SparkSession, d: str) -> tuple[Engine, DataFrame]:
    nodes, edges = tables.chunk_graph(spark, d)
    return Engine(tables.chunks(spark, d), nodes, edges), tables.questions(spark, d)


def best20(x: Engine, q: DataFrame) -> DataFrame:
    return kept(lexical.best(x.searched(), q, 20), "pool")


def companion_fusion(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    pool = best20(x, q)
    pool = pool.join(only(x.chunks.select("slot", "chunk_id"), pool, "slot"), "slot")
    scored = pool.select("query_id", "chunk_id", "score", F.lit(0).alias("stage"), F.col("rank").cast("long").alias("pos"))
    return fusion.ranked(fusion.with_companions(scored, x.edges, x.chunks), 20).select("query_id", "chunk_id", "rank", R6("score").alias("score"))


NEXT = "nxt AS (SELECT doc_id AS s, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents WHERE text <> '')"
COMPANIONS = """seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, pos, slot) AS sd FROM base) WHERE sd <= 5),
lift AS (SELECT query_id, o AS slot, max(0.9 * score) AS lift, min(sd) AS sd FROM seed JOIN nxt ON s = slot WHERE o IS NOT NULL GROUP BY ALL),
both_ AS (SELECT query_id, slot, greatest(coalesce(b.score, l.lift), coalesce(l.lift, b.score)) AS score, coalesce(b.stage, 2) AS stage, coalesce(b.pos, l.sd * 1099511627776) AS pos FROM base b FULL JOIN lift l USING (query_id, slot)),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, pos, 'd' || slot) AS rk FROM both_)
SELECT query_id, 'd' || slot AS chunk_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score FROM final WHERE rk <= 20"""
COMPANION_FUSION = f"WITH {sql.BM25F}, {sql.top('scores', 20)}, {NEXT}, base AS (SELECT query_id, slot, score, 0 AS stage, rank AS pos FROM pool), {COMPANIONS}"


def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    return x.retrieve(q).select("query_id", "chunk_id", "rank", R6("score").alias("score"))


def dynamic_cut(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    return fusion.dynamic_cut(best20(x, q), 0.55, 4, 10).select("query_id", F.col("slot").alias("doc_id"), "rank")


DYNAMIC_CUT = f"""WITH {sql.BM25F}, {sql.top('scores', 20)},
good AS (SELECT *, score >= 0.55 * max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) AS g FROM pool),
nth AS (SELECT *, g AND sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) <= 10 AS keep FROM good),
n AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS k FROM nth)
SELECT query_id, slot AS doc_id, CAST(rank AS INTEGER) AS rank FROM n WHERE CASE WHEN k < 4 THEN rank <= 4 ELSE keep END"""


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    pool = best20(x, q)
    rows = pool.join(only(x.chunks.select("slot", "text"), pool, "slot"), "slot").select("query_id", "rank", "score", "text")
    return fusion.mmr(rows).select("query_id", F.col("pick").cast("int").alias("pick"), F.col("rank").cast("int").alias("rank"))


def rank_relations(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    named_edges = graph.labelled(x.edges, x.nodes).select(F.concat_ws(" → ", "s_label", "p", "o_label").alias("relation"), "pos")
    return fusion.rank_shared_relations(named_edges, q).select("query_id", "relation", F.col("hits").cast("long").alias("hits"), "rank")


RANK_RELATIONS = f"""WITH {sql.QUESTIONS}, {NEXT}, lab AS (SELECT doc_id, substr(text, 1, 80) AS l FROM documents WHERE text <> ''),
rel AS (SELECT a.l || ' → next → ' || b.l AS relation, min(s) AS pos FROM nxt JOIN lab a ON a.doc_id = s JOIN lab b ON b.doc_id = o GROUP BY ALL),
rt AS (SELECT relation, pos, {sql.tok('relation')} AS t FROM rel),
h AS (SELECT query_id, relation, pos, len(list_intersect(list_distinct(q), t)) AS hits FROM rt CROSS JOIN qs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, pos) AS rank FROM h)
SELECT query_id, relation, CAST(hits AS BIGINT) AS hits, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40"""


def hippo_expand(spark: SparkSession, d: str) -> DataFrame:
    """Entities of chunks that the questions hit, one step into a graph of sources and languages."""
    x, q = engine(spark, d)
    docs = tables.read(spark, d, "documents").where("text <> ''")
    edges = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("pos")).select("pos", F.concat(F.lit("src:"), "source").alias("s"), F.lit("writes").alias("p"), F.concat(F.lit("lang:"), "lang").alias("o"))
    pool = best20(x, q)
    pool = kept(pool.join(only(x.chunks.select("slot", "entities"), pool, "slot"), "slot").select("query_id", F.explode("entities").alias("node")), "entities")
    near = graph.neighbor_ids(edges, pool.select("node"))
    return pool.select("query_id", "node").distinct().join(near, "node").select("query_id", "node", "other")


HIPPO = f"""WITH {sql.BM25F}, {sql.top('scores', 20)}, e AS (SELECT DISTINCT 'src:' || source AS s, 'lang:' || lang AS o FROM documents WHERE text <> ''),
ent AS (SELECT DISTINCT query_id, unnest(['src:' || source, 'lang:' || lang]) AS node FROM pool JOIN documents ON doc_id = slot)
SELECT query_id, node, o AS other FROM ent JOIN e ON s = node UNION SELECT query_id, node, s FROM ent JOIN e ON o = node"""


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    b = tables.questions(spark, d)
    own = tables.qrels(spark, d).join(tables.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    ev = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc", "text"))), lambda x: x["text"]).alias("evidence"))
    rows = b.join(ev, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    made = text.prompt(F.col("question"), F.when(F.col("query_id") % 2 == 0, "[CLASS 'x' has 2 instances: a | b]").otherwise(""), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("a → p → b"), F.lit("b → p → c"))).otherwise(F.array().cast("array<string>")), F.col("evidence"))
    return rows.select("query_id", F.sha2(made, 256).alias("prompt_sha256"), F.length(made).cast("long").alias("size"))


PROMPT = f"""WITH {sql.QRELS}, ev AS (SELECT query_id, list(text ORDER BY doc) AS e FROM qrels JOIN documents ON doc_id = doc GROUP BY query_id),
p AS (SELECT item_id AS query_id, 'Question: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || '[CLASS ''x'' has 2 instances: a | b]' ELSE '' END
  || CASE WHEN item_id % 3 = 0 THEN chr(10) || chr(10) || '[Graph relations]' || chr(10) || 'a → p → b' || chr(10) || 'b → p → c' ELSE '' END
  || CASE WHEN e IS NOT NULL THEN chr(10) || chr(10) || '[Evidence passages]' || chr(10) || array_to_string(e, chr(10) || '---' || chr(10)) ELSE '' END AS x
  FROM benchmark LEFT JOIN ev ON query_id = item_id)
SELECT query_id, sha256(x) AS prompt_sha256, CAST(length(x) AS BIGINT) AS size FROM p"""


def cited_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Names of nation-to-region relations and part classes that an answer of the nation's own name and its region's has."""
    n, r = tables.read(spark, d, "nation"), tables.read(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    relation = F.array(F.concat_ws(" → ", "n_name", F.lit("partOf"), "r_name"), F.concat_ws(" → ", F.lit("NOWHERE"), F.lit("partOf"), "r_name"))
    seed = F.concat(F.lit("[CLASS '"), "r_name", F.lit("' has 2 instances: "), "n_name", F.lit(" | Q | ELSEWHERE. List all.]"))
    answer = F.concat(F.lit("It is "), "n_name", F.lit(" in "), "r_name")
    return rows.select("n_nationkey", F.array_join(text.cited_nodes(relation, seed, answer), ",").alias("cited"))


CITED = "SELECT n_nationkey, CASE WHEN n_name < r_name THEN n_name || ',' || r_name WHEN n_name = r_name THEN n_name ELSE r_name || ',' || n_name END AS cited FROM nation JOIN region ON n_regionkey = r_regionkey"


def search_all(spark: SparkSession, d: str) -> DataFrame:
    x, q = engine(spark, d)
    out = x.search(q)
    return out.select("query_id", F.size("chunks").alias("n_chunks"), F.size("relations").alias("n_relations"), F.size("evidence_nodes").alias("n_cited"), F.length("prompt").alias("prompt_size"), F.sha2("answer", 256).alias("answer_sha256"))


QUERIES = {
    "derive_nodes": (derive_nodes, DERIVE_NODES),
    "labelled_edges": (labelled_edges, LABELLED_EDGES),
    "neighbor_ids_out": neighbor_ids("out"),
    "neighbor_ids_in": neighbor_ids("in"),
    "neighbor_ids_both": neighbor_ids("both"),
    "neighbors_1hop": (neighbors_1hop, NEIGHBORS),
    "bfs_2hop": (bfs_2hop, BFS),
    "class_instances": (class_instances, CLASS_INSTANCES),
    "count_class": (count_class, COUNT_CLASS),
    "class_seed_string": (class_seed_string, CLASS_SEED),
    "label_search": (label_search, LABEL_SEARCH),
    "title_links": (title_links, TITLE_LINKS),
    "ambiguous_aliases": (ambiguous_aliases, AMBIGUOUS),
    "title_query_match": (title_query_match, TITLE_MATCH),
    "companion_fusion": (companion_fusion, COMPANION_FUSION),
    "retrieve_topk": (retrieve_topk, None),
    "dynamic_cut": (dynamic_cut, DYNAMIC_CUT),
    "mmr_select": (mmr_select, None),
    "rank_relations": (rank_relations, RANK_RELATIONS),
    "hippo_expand": (hippo_expand, HIPPO),
    "prompt_text": (prompt_text, PROMPT),
    "cited_nodes": (cited_nodes, CITED),
    "search": (search_all, None),
}
