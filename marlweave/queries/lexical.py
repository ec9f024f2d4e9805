"""Queries of text analysis, lexical ranking, reranking, dense and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical, rerank
from ..operators.containment import only
from ..sources import tables
from ..sources.scratch import kept
from . import sql

#: Characters of the texts whose pairs a task counts.
PAIRS_OF = 8_000_000
R6 = lambda c: F.round(c, 6)


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all documents, computed once for what a query makes of them."""
    return kept(lexical.tokenized(tables.chunks(spark, d)), "tokens")


def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("slot").alias("doc_id"), F.size("body_tokens").cast("long").alias("n"), F.size(F.array_distinct("body_tokens")).cast("long").alias("kinds"))


TOKENS_PER_DOC = f"WITH {sql.DOCS} SELECT slot AS doc_id, CAST(len(b) AS BIGINT) AS n, CAST(len(list_distinct(b)) AS BIGINT) AS kinds FROM docs"


def vocab_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.vocabulary(docs(spark, d)).select("term", "df", "dfe")


VOCAB_DF = f"WITH {sql.DOCS}, {sql.POSTINGS} SELECT term, count(*) AS df, CAST(0 AS BIGINT) AS dfe FROM post GROUP BY term"


def sstem_map(spark: SparkSession, d: str) -> DataFrame:
    words = tables.chunks(spark, d).select(F.explode(text.latin_words("text")).alias("word")).distinct()
    return words.select("word", text.s_stem(F.col("word")).alias("stem"))


SSTEM_MAP = f"SELECT w AS word, {sql.STEM} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)"


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_terms(tables.questions(spark, d, "What is the meaning of these "))


QUERY_TERMS = f"WITH qs AS (SELECT item_id AS query_id, {sql.qtok(chr(39) + 'What is the meaning of these ' + chr(39) + ' || text')} AS q FROM benchmark), {sql.TERMS} SELECT query_id, term, qtf FROM terms"


def token_bigrams(spark: SparkSession, d: str) -> DataFrame:
    c = tables.chunks(spark, d).select("text")
    size = c.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # a task counts the pairs of so many texts before they are shuffled, and holds them meanwhile
    spread = c.repartition(max(1, -(-size // PAIRS_OF))).select(text.tokens("text").alias("t"))
    return spread.select(F.explode(text.pairs(F.col("t"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


TOKEN_BIGRAMS = f"WITH {sql.DOCS}, p AS (SELECT unnest({sql.pairs('b')}) AS pair FROM docs) SELECT pair, count(*) AS n FROM p GROUP BY pair HAVING count(*) > 1"


def title_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = text.with_title_aliases(tables.chunks(spark, d).select(F.col("slot").alias("doc_id"), "title"), "title", "names")
    return rows.select("doc_id", F.explode("names").alias("a")).select("doc_id", F.array_join("a", " ").alias("alias"))


TITLE_ALIASES = f"""WITH x AS (SELECT doc_id, {sql.tok("trim(regexp_replace(substr(text, 1, 80), '\\s*\\([^()]*\\)\\s*$', ''))")} AS t FROM documents WHERE text <> ''),
y AS (SELECT doc_id, t, list_filter(range(3, len(t) + 1), lambda i: t[i] IN ('from', 'in', 'of')) AS spot FROM x WHERE len(t) >= 2)
SELECT DISTINCT doc_id, array_to_string(t, ' ') AS alias FROM y
UNION SELECT doc_id, array_to_string(list_slice(t, 1, spot[1] - 1), ' ') FROM y WHERE len(spot) > 0"""


def field_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.field_stats(docs(spark, d)).select("n", R6("avg_title").alias("avg_title"), R6("avg_body").alias("avg_body"))


FIELD_STATS = f"WITH {sql.DOCS}, {sql.STATS} SELECT n, round(avg_t, 6) AS avg_title, round(avg_b, 6) AS avg_body FROM stats"


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return lexical.vocabulary(x).crossJoin(F.broadcast(lexical.field_stats(x))).select("term", "df", R6(lexical.idf(F.col("n"), F.col("df"))).alias("idf"))


IDF_TABLE = f"WITH {sql.DOCS}, {sql.POSTINGS}, {sql.STATS}, d AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT term, df, round({sql.idf('df')}, 6) AS idf FROM d CROSS JOIN stats"


def bm25(spark: SparkSession, d: str, **how) -> DataFrame:
    hits = lexical.best(lexical.texts(tables.chunks(spark, d)), tables.questions(spark, d), 20, fielded=False, **how)
    return hits.select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


def top20(ctes: str) -> str:
    return f"WITH {ctes}, {sql.top('scores', 20)} SELECT query_id, slot AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM pool"


def bm25f_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.best(lexical.texts(tables.chunks(spark, d)), tables.questions(spark, d), 20)
    return hits.select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


def fetch_ordered(spark: SparkSession, d: str) -> DataFrame:
    labels = tables.read(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("pos"))
    twice = labels.unionByName(labels.select("chunk_id", (F.col("pos") + 1_000_000_000).alias("pos")))
    return lexical.fetch(tables.chunks(spark, d).select("chunk_id", "title"), twice).select("pos", "chunk_id", "title")


FETCH_ORDERED = """SELECT x.pos, 'd' || doc_id AS chunk_id, substr(text, 1, 80) AS title
FROM (SELECT doc_id, doc_id AS pos FROM labels UNION ALL SELECT doc_id, doc_id + 1000000000 FROM labels) x JOIN documents USING (doc_id) WHERE text <> ''"""


def frontier(spark: SparkSession, d: str, prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    c, q = tables.chunks(spark, d), tables.questions(spark, d, prefix)
    return kept(lexical.best(lexical.texts(c), q, 40, coordinated=True), "frontier"), q, c


def near(pool: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """The questions and texts of a frontier; only its own texts are shuffled."""
    return pool.join(q, "query_id").join(kept(only(c.select("slot", "title", "text"), pool, "slot"), "frontier-texts"), "slot")


def bigram_fraction(spark: SparkSession, d: str) -> DataFrame:
    pool, q, c = frontier(spark, d)
    rows = near(pool, q, c).withColumns({"q": text.query_tokens("question"), "t": text.tokens(F.concat_ws(" ", "title", "text"))})
    return rows.select("query_id", F.col("slot").alias("doc_id"), R6(text.pair_fraction(F.col("q"), F.col("t"))).alias("fraction"))


FRACTION = f"CASE WHEN len({sql.pairs('q')}) = 0 THEN 0.0 ELSE len(list_intersect({sql.pairs('q')}, {sql.pairs('full_t')})) / len({sql.pairs('q')}) END"
FRONTIER = f"""{sql.BM25F}, {sql.top('scores', 40)},
near AS (SELECT p.*, question, q, title, text, list_concat(t, b) AS full_t FROM pool p JOIN qs USING (query_id) JOIN docs USING (slot)),
lifted AS (SELECT *, {FRACTION} AS fraction, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS hits FROM near),
phrased AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hits >= 2 AND len(q) >= 3 THEN 0 ELSE rank END, round(score + top * 0.5 * fraction, 9) DESC, slot) AS phrase FROM lifted)"""
BIGRAM_FRACTION = f"WITH {FRONTIER} SELECT query_id, slot AS doc_id, round(fraction, 6) AS fraction FROM lifted"


def phrase_rank(spark: SparkSession, d: str) -> DataFrame:
    pool, q, c = frontier(spark, d)
    return rerank.rerank(pool, q, c).select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


FOLD = "replace(lower({0}), 'ß', 'ss')".format
SURFACE = f"""seen AS (SELECT *, {FOLD('question')} AS fq, {FOLD('title')} AS ft, {FOLD('text')} AS fb FROM phrased),
words AS (SELECT *, list_filter(regexp_split_to_array(fq, '\\s+'), lambda w: w <> '') AS ws FROM seen),
counts AS (SELECT *, len(ws) AS nw, len(list_filter(ws, lambda w: contains(ft, w))) AS in_t, len(list_filter(ws, lambda w: contains(fb, w))) AS in_b,
  len(list_filter(ws, lambda w: contains(ft, w) OR contains(fb, w))) AS met,
  len(list_filter(range(1, len(ws)), lambda i: contains(ft, ws[i] || ' ' || ws[i + 1]) OR contains(fb, ws[i] || ' ' || ws[i + 1]))) AS beside FROM words),
surfaced AS (SELECT *, CASE WHEN nw = 0 THEN 0.0 ELSE (CASE WHEN contains(ft, fq) THEN 3.0 * nw ELSE 0 END) + 2 * in_t + in_b + 1.5 * beside
  + (CASE WHEN met / nw >= 0.8 THEN 1.5 * nw WHEN met / nw >= 0.5 THEN 0.5 * nw ELSE 0 END) END AS surface FROM counts)"""

PHRASE_RANK = f"""WITH {FRONTIER}, {SURFACE},
own AS (SELECT *, hits >= 2 AND len(q) >= 3 AND len(list_intersect(regexp_extract_all(replace(lower(question), '’', ''''), '[a-z]+(?:''[a-z]+)?'), {sql.PERSONAL_LIST})) > 0 AS fuse,
  0.4 / phrase + 0.6 / row_number() OVER (PARTITION BY query_id ORDER BY surface DESC, phrase) AS f FROM surfaced),
done AS (SELECT *, CASE WHEN fuse THEN round(top * f / max(f) OVER (PARTITION BY query_id), 9) ELSE score END AS final FROM own)
SELECT query_id, slot AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fuse THEN -final ELSE 0 END, CASE WHEN fuse THEN slot ELSE 0 END, phrase) AS INTEGER) AS rank, round(final, 6) AS score FROM done"""


def surface_score(spark: SparkSession, d: str) -> DataFrame:
    pool, q, c = frontier(spark, d)
    rows = near(pool, q, c)
    return rows.select("query_id", F.col("slot").alias("doc_id"), R6(text.surface_score("question", "title", "text")).alias("surface"))


SURFACE_SCORE = f"WITH {FRONTIER}, {SURFACE} SELECT query_id, slot AS doc_id, round(CAST(surface AS DOUBLE), 6) AS surface FROM surfaced"


def inverse_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    pool, q, c = frontier(spark, d, "my ")
    return rerank.rerank(pool, q, c).select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


INVERSE_RANK_FUSION = f"""WITH {(FRONTIER + ', ' + SURFACE).replace("SELECT item_id AS query_id, text AS question, ", "SELECT item_id AS query_id, 'my ' || text AS question, ").replace(sql.qtok('text') + ' AS q FROM benchmark', sql.qtok("'my ' || text") + ' AS q FROM benchmark')},
fused AS (SELECT *, 0.4 / phrase + 0.6 / row_number() OVER (PARTITION BY query_id ORDER BY surface DESC, phrase) AS f FROM surfaced),
done AS (SELECT query_id, slot, round(top * f / max(f) OVER (PARTITION BY query_id), 9) AS score FROM fused)
SELECT query_id, slot AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot) AS INTEGER) AS rank, round(score, 6) AS score FROM done"""


def personal_flag(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "conversations").select("conv_id", "turn", text.is_personal("text").alias("personal"))


PERSONAL_FLAG = f"SELECT conv_id, turn, len(list_intersect(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?'), {sql.PERSONAL_LIST})) > 0 AS personal FROM conversations"


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as chunks; those whose id is divisible by 20 ask."""
    e = tables.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("slot"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    c, q = vectors(spark, d)
    return rerank.dense_search(c, q, 20).select("query_id", F.col("slot").alias("vec_id"), "rank", R6("score").alias("score"))


DENSE = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), ask AS (SELECT vec_id FROM v WHERE vec_id % 20 = 0), pairs AS (SELECT a.vec_id AS query_id, c.vec_id AS slot, list_cosine_similarity(a.e, c.e) AS score FROM ask JOIN v a USING (vec_id) CROSS JOIN v c), dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot) AS rank FROM pairs) WHERE rank <= 20)"
COSINE_TOPK = f"WITH {DENSE} SELECT query_id, slot AS vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dense"


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A dense list, and a second one by distance of ids, that meets it in part."""
    c, q = vectors(spark, d)
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") - 15, F.col("query_id") + 15)).alias("slot")).join(c.select("slot"), "slot")
    other = near.select("query_id", "slot", (1.0 / (1.0 + F.abs(F.col("slot") - F.col("query_id")))).alias("score"))
    return rerank.dense_search(c, q, 20).select("query_id", "slot", "score"), other


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return rerank.hybrid(*two_lists(spark, d), 20).select("query_id", F.col("slot").alias("vec_id"), "rank", R6("score").alias("score"))


MINMAX = "(score - min(score) OVER (PARTITION BY query_id)) / (CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1 ELSE max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) END)"
HYBRID_TOPK = f"""WITH {DENSE}, other AS (SELECT a.vec_id AS query_id, c.vec_id AS slot, 1.0 / (1.0 + abs(c.vec_id - a.vec_id)) AS score FROM ask a JOIN v c ON abs(c.vec_id - a.vec_id) <= 15),
x AS (SELECT query_id, slot, {MINMAX} AS s FROM dense), y AS (SELECT query_id, slot, {MINMAX} AS s FROM other),
z AS (SELECT query_id, slot, coalesce(x.s, 0) + 0.8 * coalesce(y.s, 0) AS score FROM x FULL JOIN y USING (query_id, slot)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot) AS rank FROM z)
SELECT query_id, slot AS vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20"""


def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vectors import minmax

    return two_lists(spark, d)[0].select("query_id", F.col("slot").alias("vec_id"), R6(minmax("score")).alias("score"))


MINMAX_NORM = f"WITH {DENSE} SELECT query_id, slot AS vec_id, round({MINMAX}, 6) AS score FROM dense"

QUERIES = {
    "tokens_per_doc": (tokens_per_doc, TOKENS_PER_DOC),
    "vocab_df": (vocab_df, VOCAB_DF),
    "sstem_map": (sstem_map, SSTEM_MAP),
    "query_terms": (query_terms, QUERY_TERMS),
    "token_bigrams": (token_bigrams, TOKEN_BIGRAMS),
    "title_aliases": (title_aliases, TITLE_ALIASES),
    "field_stats": (field_stats, FIELD_STATS),
    "idf_table": (idf_table, IDF_TABLE),
    "bm25_topk": (lambda s, d: bm25(s, d, multiplicity=False), top20(sql.bm25("1"))),
    "bm25_multiplicity": (bm25, top20(sql.bm25())),
    "bm25_idf_pow1": (lambda s, d: bm25(s, d, config=lexical.Config(idf_pow=1.0)), top20(sql.bm25(power=1.0))),
    "bm25f_topk": (bm25f_topk, top20(sql.BM25F)),
    "fetch_ordered": (fetch_ordered, FETCH_ORDERED),
    "bigram_fraction": (bigram_fraction, BIGRAM_FRACTION),
    "phrase_rank": (phrase_rank, PHRASE_RANK),
    "surface_score": (surface_score, SURFACE_SCORE),
    "inverse_rank_fusion": (inverse_rank_fusion, INVERSE_RANK_FUSION),
    "personal_flag": (personal_flag, PERSONAL_FLAG),
    "cosine_topk": (cosine_topk, COSINE_TOPK),
    "minmax_norm": (minmax_norm, MINMAX_NORM),
    "hybrid_topk": (hybrid_topk, HYBRID_TOPK),
}
