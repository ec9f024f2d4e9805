"""Queries of the mutable store, constructors, citations, Korean text and the evaluation's other metrics; SQL of whole retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul, text
from ..operators import citations, graph, lexical, metrics
from ..plans import build
from ..plans.store import Store
from ..sources import tables
from ..sources.scratch import scratch
from . import graphs, sql, state
from .lexical import FRONTIER, R6, SURFACE

RETRIEVE_TOPK = f"""WITH {FRONTIER}, {SURFACE},
own AS (SELECT *, hits >= 2 AND len(q) >= 3 AND len(list_intersect(regexp_extract_all(replace(lower(question), '’', ''''), '[a-z]+(?:''[a-z]+)?'), {sql.PERSONAL_LIST})) > 0 AS fuse,
  0.4 / phrase + 0.6 / row_number() OVER (PARTITION BY query_id ORDER BY surface DESC, phrase) AS f FROM surfaced),
done AS (SELECT *, CASE WHEN fuse THEN round(top * f / max(f) OVER (PARTITION BY query_id), 9) ELSE score END AS final FROM own),
hit AS (SELECT * FROM (SELECT query_id, slot, final AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fuse THEN -final ELSE 0 END, CASE WHEN fuse THEN slot ELSE 0 END, phrase) AS rank FROM done) WHERE rank <= 20),
{graphs.LABELS}, {sql.top('lscores', 30, 'lpool')},
cut AS (SELECT p.query_id, p.slot, p.rank AS label_rank, {sql.tok("trim(regexp_replace(substr(d.text, 1, 80), '\\s*\\([^()]*\\)\\s*$', ''))")} AS t, {sql.tok('question')} AS asked,
  greatest(len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')), 1) AS words FROM lpool p JOIN docs d USING (slot) JOIN qs USING (query_id)),
spots AS (SELECT *, list_filter(range(3, len(t) + 1), lambda i: t[i] IN ('from', 'in', 'of')) AS spot FROM cut WHERE len(t) >= 2),
alias AS (SELECT query_id, slot, label_rank, words, asked, t AS a FROM spots UNION SELECT query_id, slot, label_rank, words, asked, list_slice(t, 1, spot[1] - 1) FROM spots WHERE len(spot) > 0),
places AS (SELECT *, unnest(range(0, len(asked) - len(a) + 1)) AS o FROM alias WHERE len(asked) >= len(a)),
wrong AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] <> asked[o + i]) AS w FROM places),
aff AS (SELECT query_id, slot, label_rank, words, o, CASE WHEN len(w) = 0 THEN 1.0 WHEN len(w) = 1 AND levenshtein(a[w[1]], asked[o + w[1]]) <= 1 THEN 0.95 END AS aff FROM wrong),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slot ORDER BY aff DESC, o) AS r FROM aff WHERE aff IS NOT NULL) WHERE r = 1),
lifted_t AS (SELECT b.query_id, b.slot, h.score * (1.0 + 0.2 - 0.08 * least(1.0, o / words) + 0.02 * aff) AS lift, label_rank FROM best b JOIN hit h ON h.query_id = b.query_id AND h.rank = 1),
base AS (SELECT query_id, slot, greatest(coalesce(h.score, l.lift), coalesce(l.lift, h.score)) AS score, CASE WHEN h.rank IS NULL THEN 1 ELSE 0 END AS stage, coalesce(h.rank, label_rank) AS pos FROM hit h FULL JOIN lifted_t l USING (query_id, slot)),
{graphs.NEXT}, {graphs.COMPANIONS}"""

HEAD_TO_HEAD = f"""WITH {sql.BM25F}, {sql.top('scores', 20)}, {sql.BODY}, bdf AS (SELECT term, count(*) AS df FROM body GROUP BY term),
bscores AS (SELECT query_id, slot, round(sum(qtf * {sql.idf('df')} * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * greatest(len(b), 1) / avg_b))), 9) AS score FROM terms JOIN body USING (term) JOIN bdf USING (term) JOIN docs USING (slot) CROSS JOIN stats GROUP BY ALL),
{sql.top('bscores', 20, 'bpool')}, {sql.QRELS}, {state.metric_ctes('pool', 'm')}, {state.metric_ctes('bpool', 'x')}
SELECT CAST(sum(CASE WHEN m.rr - x.rr > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN x.rr - m.rr > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN abs(m.rr - x.rr) <= 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM m JOIN x USING (query_id)"""

NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))".format
WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= 2))".format
CUT = "array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 2048), ' ')"
ANSWER_SCORES = rf"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
n AS (SELECT conv_id, turn, {NORMAL('text')} AS a, {NORMAL('gold')} AS g, {NORMAL(CUT)} AS c FROM t WHERE gold IS NOT NULL),
w AS (SELECT *, {WORDS('a')} AS x, {WORDS('g')} AS y, {WORDS('c')} AS z FROM n)
SELECT conv_id, turn, round(CASE WHEN length(g) = 0 THEN 0.0 WHEN contains(a, g) THEN 1.0 WHEN len(list_intersect(x, y)) = 0 THEN 0.0 WHEN len(list_intersect(x, y)) = len(y) THEN 0.9 ELSE CAST(2 * len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y)) END, 6) AS correctness,
  round(CASE WHEN length(g) = 0 THEN 0.0 WHEN contains(c, g) THEN 1.0 WHEN len(y) = 0 THEN 0.0 ELSE CAST(len(list_intersect(z, y)) AS DOUBLE) / len(y) END, 6) AS support FROM w"""


def derived_edges(spark: SparkSession, d: str) -> DataFrame:
    """Title links of all documents that the benchmark's own edges do not hold already."""
    chunks, b = graphs.named(spark, d)
    known = tables.qrels(spark, d).select(F.concat(F.lit("d"), "doc").alias("s"), F.lit("references").alias("p"), F.concat(F.lit("b"), "query_id").alias("o"), F.col("doc").alias("pos")).where("pos % 2 = 0")
    return build.new_edges(known, graphs.linking.title_links(chunks)).select("s", "p", "o")


DERIVED_EDGES = f"WITH {sql.QRELS}, l AS ({graphs.TITLE_LINKS}) SELECT s, p, o FROM l WHERE NOT EXISTS (SELECT 1 FROM qrels WHERE doc % 2 = 0 AND 'd' || doc = s AND 'b' || query_id = o)"


def get_node(spark: SparkSession, d: str) -> DataFrame:
    ids = tables.read(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return graph.get_nodes(graphs.trade(spark, d)[1], ids.unionByName(ids.select(F.concat("node_id", F.lit("?")).alias("node_id"))))


GET_NODE = f"WITH {sql.TRADE}, i AS (SELECT 's:' || s_suppkey AS node_id FROM supplier UNION ALL SELECT 's:' || s_suppkey || '?' FROM supplier) SELECT i.node_id, label, kind FROM i LEFT JOIN nodes n ON n.node_id = i.node_id"


def end_to_end_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.end_to_end(state.ranked(spark, d), tables.qrels(spark, d), 5)
    return rows.select("query_id", "retrieved", "gold", "hits", *[R6(c).alias(c) for c in ("precision", "recall", "f1", "rr", "ndcg")], "hit", "all_gold")


DCG = "list_sum(list_transform(range(1, {0} + 1), lambda i: 1.0 / log2(i + 1)))".format
JUDGED = f"{sql.BM25F}, {sql.top('scores', 20)}, {sql.QRELS}, need AS (SELECT query_id, count(DISTINCT doc) AS gold FROM qrels GROUP BY query_id)"
END_TO_END = f"""WITH {JUDGED},
j AS (SELECT n.query_id, gold, rank, CASE WHEN q.doc IS NOT NULL THEN 1 ELSE 0 END AS h FROM need n LEFT JOIN (SELECT * FROM pool WHERE rank <= 5) p ON p.query_id = n.query_id LEFT JOIN qrels q ON q.query_id = n.query_id AND q.doc = p.slot),
a AS (SELECT query_id, gold, count(rank) AS retrieved, CAST(sum(h) AS BIGINT) AS hits, min(CASE WHEN h = 1 THEN rank END) AS first, sum(CASE WHEN h = 1 THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY ALL)
SELECT query_id, retrieved, gold, hits, round(hits / 5, 6) AS "precision", round(hits / gold, 6) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / 5) * (hits / gold) / (hits / 5 + hits / gold) ELSE 0.0 END, 6) AS f1,
  round(CAST(coalesce(1.0 / first, 0.0) AS DOUBLE), 6) AS rr, round(dcg / {DCG('least(gold, 5)')}, 6) AS ndcg, hits > 0 AS hit, hits = gold AS all_gold FROM a"""


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Passages as questions, documents as sessions; passages that no document holds are not eligible, and have -1 for values."""
    rows = metrics.sessions(state.ranked(spark, d), tables.qrels(spark, d))
    return rows.select("query_id", "eligible", "gold", "retrieved", "hits", *[F.coalesce(R6(c), F.lit(-1.0)).alias(c) for c in ("session_recall", "rr", "ndcg")], F.coalesce(F.col("session_hit").cast("int"), F.lit(-1)).alias("session_hit"))


SESSION_METRICS = f"""WITH {JUDGED},
g AS (SELECT p.query_id, count(*) AS retrieved, count(q.doc) AS hits, min(CASE WHEN q.doc IS NOT NULL THEN rank END) AS first, sum(CASE WHEN q.doc IS NOT NULL THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg FROM pool p LEFT JOIN qrels q ON q.query_id = p.query_id AND q.doc = p.slot GROUP BY p.query_id),
a AS (SELECT query_id, coalesce(gold, 0) AS gold, coalesce(retrieved, 0) AS retrieved, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg FROM g FULL JOIN need USING (query_id))
SELECT query_id, gold > 0 AS eligible, gold, retrieved, hits, CASE WHEN gold > 0 THEN round(hits / gold, 6) ELSE -1.0 END AS session_recall, CASE WHEN gold > 0 THEN round(CAST(coalesce(1.0 / first, 0.0) AS DOUBLE), 6) ELSE -1.0 END AS rr,
  CASE WHEN gold > 0 THEN round(CASE WHEN least(gold, retrieved) > 0 THEN dcg / {DCG('least(gold, retrieved)')} ELSE 0.0 END, 6) ELSE -1.0 END AS ndcg, CASE WHEN gold > 0 THEN CAST(hits > 0 AS INTEGER) ELSE -1 END AS session_hit FROM a"""


def memory_effect(spark: SparkSession, d: str) -> DataFrame:
    """Recall of ranking by fields against that of bodies alone, apart for passages with a hit document of even id."""
    q, c = tables.qrels(spark, d), state.counts(spark, d)
    rows = metrics.memory_effect(metrics.per_query(state.ranked(spark, d, False, c), q), metrics.per_query(state.ranked(spark, d, True, c), q), q.where("doc % 2 = 0"), "recall")
    return rows.select("covered", "n", *[R6(c).alias(c) for c in ("cold", "warm", "delta")])


MEMORY_EFFECT = HEAD_TO_HEAD[: HEAD_TO_HEAD.rindex("SELECT CAST(sum(CASE WHEN m.rr")] + """SELECT query_id IN (SELECT query_id FROM qrels WHERE doc % 2 = 0) AS covered, count(*) AS n, round(avg(x.recall), 6) AS cold, round(avg(m.recall), 6) AS warm, round(avg(m.recall - x.recall), 6) AS delta FROM m JOIN x USING (query_id) GROUP BY ALL"""


def best_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk_id"), "text")
    return metrics.best_chunk(c, 30, 2500).select("doc", "chunk_id", F.col("size").cast("long").alias("size"))


BEST_CHUNK = "SELECT conv_id AS doc, turn AS chunk_id, CAST(n AS BIGINT) AS size FROM (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations WHERE length(text) BETWEEN 30 AND 2500) WHERE r = 1"


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Each nation as an article of its region's law, that cites its neighbour by number at home and abroad."""
    n = tables.read(spark, d, "nation")
    number = lambda c: F.concat(F.lit("제"), c.cast("string"), F.lit("조"))
    body = F.concat(number(F.col("n_nationkey") + 5), F.lit(" 및 「법"), ((F.col("n_regionkey") + 1) % 6).cast("string"), F.lit("」 "), number(F.col("n_nationkey") + 1), F.lit("에 따라 "), number(F.col("n_nationkey")), F.lit("의2"))
    return n.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("법"), F.col("n_regionkey").cast("string")).alias("law"), number(F.col("n_nationkey")).alias("article_no"), hangul.nfc(body).alias("text"))


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return citations.citations(articles(spark, d))


CITATION_EDGES = """WITH c AS (SELECT n_nationkey AS s, n_regionkey AS r, n_nationkey + 5 AS k FROM nation
  UNION ALL SELECT n_nationkey, CASE WHEN (n_regionkey + 1) % 6 IN (SELECT n_regionkey FROM nation) THEN (n_regionkey + 1) % 6 ELSE n_regionkey END, n_nationkey + 1 FROM nation)
SELECT DISTINCT CAST(s AS VARCHAR) AS s, 'references' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM c JOIN nation ON n_regionkey = r AND n_nationkey = k"""

KOREAN = {"어디인가": "어디", "어디인가요": "어디", "무엇인가": "무엇", "누구입니까": "누구", "상황": "상황", "인가": "인가", "승인가능": "승인가능", "부동산": "부동산"}


def korean_stems(spark: SparkSession, d: str) -> DataFrame:
    """The stems of known words, and what a text of each holds as tokens."""
    rows = spark.createDataFrame([(w,) for w in KOREAN], "word string")
    return rows.select("word", F.array_join(hangul.stems("word"), " ").alias("stem"), F.array_join(text.tokens(F.concat(F.lit("Statins "), "word", F.lit(" 2"))), " ").alias("tokens"))


def _tokens(stem: str) -> str:
    return " ".join(["statin", "2", *(stem[i : i + 2] for i in range(len(stem) - 1)), f"#{stem}"])


KOREAN_STEMS = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}', '{_tokens(s)}')" for w, s in KOREAN.items()) + ") AS t(word, stem, tokens)"


def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranking over a store after upserts (labelled documents of low quality), deletes (toxic ones), confirmed questions and a compaction."""
    labels = tables.read(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "quality", "toxic")
    chunks, (nodes, edges) = tables.chunks(spark, d), tables.chunk_graph(spark, d)
    store = Store.create(chunks, nodes, edges, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    revised = chunks.join(labels.where("quality = 0"), "chunk_id").select("chunk_id", "title", F.concat("text", F.lit(" revised")).alias("text"))
    store.upsert_chunks(revised)
    store.compact()
    store.delete_chunks(labels.where("toxic = 1"))
    store.remember("zzmemory", labels.where("quality = 1"))
    hits = lexical.best(store.view().searched(), tables.questions(spark, d, "zzmemory revised "), 20)
    return hits.select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


STORE_SEARCH = f"""WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
now AS (SELECT doc_id, text AS old, CASE WHEN doc_id IN (SELECT doc_id FROM low) THEN text || ' revised' ELSE text END AS text FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM bad)),
docs AS (SELECT doc_id AS slot, {sql.tok('substr(old, 1, 80)')} AS t, {sql.tok('text')} AS b FROM now),
qs AS (SELECT item_id AS query_id, {sql.qtok("'zzmemory revised ' || text")} AS q FROM benchmark), {sql.TERMS}, {sql.STATS},
post AS (SELECT slot, term, sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) AS tf_title, sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS tf_body, sum(CASE WHEN f = 2 THEN 1 ELSE 0 END) AS tf_memory
  FROM (SELECT slot, unnest(t) AS term, 0 AS f FROM docs UNION ALL SELECT slot, unnest(b), 1 FROM docs UNION ALL SELECT slot, 'zzmemory', 2 FROM docs WHERE slot IN (SELECT doc_id FROM good)) GROUP BY ALL),
df AS (SELECT term, sum(CASE WHEN tf_title + tf_body > 0 THEN 1 ELSE 0 END) AS df, sum(CASE WHEN tf_memory > 0 THEN 1 ELSE 0 END) AS dfe FROM post GROUP BY term),
hits AS (SELECT query_id, slot, {sql.idf('(CASE WHEN df > 0 THEN df ELSE dfe END)')} AS w, 4.0 * tf_title / (0.25 + 0.75 * greatest(len(t), 1) / avg_t) + tf_body / (0.25 + 0.75 * greatest(len(b), 1) / avg_b) + tf_memory AS tf
  FROM terms JOIN post USING (term) JOIN df USING (term) JOIN docs USING (slot) CROSS JOIN stats),
scores AS (SELECT query_id, slot, round(sum(w * tf * 2.5 / (1.5 + tf)), 9) AS score FROM hits GROUP BY ALL), {sql.top('scores', 20)}
SELECT query_id, slot AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM pool"""

QUERIES = {
    "retrieve_topk": (graphs.retrieve_topk, RETRIEVE_TOPK),
    "head_to_head": (state.head_to_head, HEAD_TO_HEAD),
    "answer_scores": (state.answer_scores, ANSWER_SCORES),
    "derived_edges": (derived_edges, DERIVED_EDGES),
    "get_node": (get_node, GET_NODE),
    "end_to_end_metrics": (end_to_end_metrics, END_TO_END),
    "session_metrics": (session_metrics, SESSION_METRICS),
    "memory_effect": (memory_effect, MEMORY_EFFECT),
    "best_chunk": (best_chunk, BEST_CHUNK),
    "citation_edges": (citation_edges, CITATION_EDGES),
    "korean_stems": (korean_stems, KOREAN_STEMS),
    "store_search": (store_search, STORE_SEARCH),
}
