"""Queries of memory, vault, changes and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lexical, memory, metrics, mutation
from ..sources import tables
from ..sources.scratch import kept, scratch
from ..streaming import changes
from . import sql
from .lexical import R6


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """(slot, chunk_id, query, seq): the passages that documents hold, as confirmed questions of them."""
    rows = tables.qrels(spark, d).join(tables.questions(spark, d), "query_id")
    return rows.select(F.col("doc").alias("slot"), F.concat(F.lit("d"), F.col("doc").cast("string")).alias("chunk_id"), F.concat(F.lit("zzmemory "), "question").alias("query"), F.col("query_id").alias("seq"))


def feedback_bm25f(spark: SparkSession, d: str) -> DataFrame:
    docs = lexical.texts(tables.chunks(spark, d), feedback(spark, d))
    hits = lexical.best(docs, tables.questions(spark, d, "zzmemory "), 20)
    return hits.select("query_id", F.col("slot").alias("doc_id"), "rank", R6("score").alias("score"))


MEMORY = f"""{sql.DOCS}, {sql.QRELS}, mem AS (SELECT doc AS slot, unnest({sql.tok("'zzmemory ' || text")}) AS term FROM qrels JOIN benchmark ON item_id = query_id),
post AS (SELECT slot, term, sum(f = 0) AS tf_title, sum(f = 1) AS tf_body, sum(f = 2) AS tf_memory FROM (SELECT slot, unnest(t) AS term, 0 AS f FROM docs UNION ALL SELECT slot, unnest(b), 1 FROM docs UNION ALL SELECT slot, term, 2 FROM mem) GROUP BY ALL),
df AS (SELECT term, sum(tf_title + tf_body > 0) AS df, sum(tf_memory > 0) AS dfe FROM post GROUP BY term)"""
MEMORY = MEMORY.replace("sum(f = 0)", "sum(CASE WHEN f = 0 THEN 1 ELSE 0 END)").replace("sum(f = 1)", "sum(CASE WHEN f = 1 THEN 1 ELSE 0 END)").replace("sum(f = 2)", "sum(CASE WHEN f = 2 THEN 1 ELSE 0 END)")
MEMORY = MEMORY.replace("sum(tf_title + tf_body > 0)", "sum(CASE WHEN tf_title + tf_body > 0 THEN 1 ELSE 0 END)").replace("sum(tf_memory > 0)", "sum(CASE WHEN tf_memory > 0 THEN 1 ELSE 0 END)")
FEEDBACK_BM25F = f"""WITH {MEMORY}, {sql.STATS}, qs AS (SELECT item_id AS query_id, {sql.qtok("'zzmemory ' || text")} AS q FROM benchmark), {sql.TERMS},
hits AS (SELECT query_id, slot, {sql.idf('(CASE WHEN df > 0 THEN df ELSE dfe END)')} AS w, 4.0 * tf_title / (0.25 + 0.75 * greatest(len(t), 1) / avg_t) + tf_body / (0.25 + 0.75 * greatest(len(b), 1) / avg_b) + tf_memory AS tf
  FROM terms JOIN post USING (term) JOIN df USING (term) JOIN docs USING (slot) CROSS JOIN stats),
scores AS (SELECT query_id, slot, round(sum(w * tf * 2.5 / (1.5 + tf)), 9) AS score FROM hits GROUP BY ALL), {sql.top('scores', 20)}
SELECT query_id, slot AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM pool"""


def evidence_only_idf(spark: SparkSession, d: str) -> DataFrame:
    said = kept(feedback(spark, d), "feedback")
    stats = lexical.memory_stats(lexical.texts(tables.chunks(spark, d), said), said)
    return stats.select("term", "df", "dfe", R6(lexical.idf(F.col("n"), F.coalesce(F.nullif("df", F.lit(0)), "dfe"))).alias("idf"))


EVIDENCE_IDF = f"WITH {MEMORY}, {sql.STATS} SELECT term, CAST(df AS BIGINT) AS df, CAST(dfe AS BIGINT) AS dfe, round({sql.idf('(CASE WHEN df > 0 THEN df ELSE dfe END)')}, 6) AS idf FROM df CROSS JOIN stats WHERE dfe > 0"


def feedback_text(spark: SparkSession, d: str) -> DataFrame:
    said = feedback(spark, d).select("chunk_id", "query", "seq")
    again = said.select("chunk_id", F.concat(F.lit("  "), "query").alias("query"), (F.col("seq") + 1000).alias("seq"))
    kept = memory.remember(memory.remember(said, again), said.select("chunk_id", F.lit("  ").alias("query"), "seq"))
    gone = said.where("seq % 5 = 0").select("chunk_id", "query")
    return memory.text(memory.forget(kept, gone)).select("chunk_id", F.sha2("text", 256).alias("text_sha256"))


FEEDBACK_TEXT = f"WITH {sql.QRELS} SELECT 'd' || doc AS chunk_id, sha256(string_agg('zzmemory ' || text, ' ' ORDER BY query_id)) AS text_sha256 FROM qrels JOIN benchmark ON item_id = query_id WHERE query_id % 5 <> 0 GROUP BY doc"


def facts(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders")
    return o.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("s"), F.lit("orders").alias("p"), F.col("o_orderpriority").alias("o"), F.col("o_orderkey").alias("pos"))


def vault_salience(spark: SparkSession, d: str) -> DataFrame:
    known = facts(spark, d).where("o = '1-URGENT'")
    new = memory.fuse_facts(known, facts(spark, d))
    notes = tables.read(spark, d, "customer").select(F.array(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), "c_mktsegment").alias("entities"))
    surfaced = tables.read(spark, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("label"))
    return memory.salience(memory.salience_events(new, notes, surfaced)).select("label", R6("value").alias("value"))


VAULT_SALIENCE = """WITH f AS (SELECT DISTINCT 'c:' || o_custkey AS s, o_orderpriority AS o FROM orders WHERE o_orderpriority <> '1-URGENT'),
e AS (SELECT s AS label, 1.0 AS a FROM f UNION ALL SELECT o, 1.0 FROM f UNION ALL SELECT 'c:' || c_custkey, 1.0 FROM customer UNION ALL SELECT c_mktsegment, 1.0 FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 0.5 FROM customer WHERE c_acctbal > 5000)
SELECT label, round(CAST(sum(a) AS DOUBLE), 6) AS value FROM e GROUP BY label"""


def vault_autolink(spark: SparkSession, d: str) -> DataFrame:
    notes = tables.read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("note_id"), "text")
    labels = tables.read(spark, d, "documents").select(F.explode(F.split(F.substring("text", 1, 80), "\\s+")).alias("label")).where("length(label) >= 6")
    return memory.auto_entities(notes, labels).select("note_id", F.array_join("entities", ",").alias("entities"))


VAULT_AUTOLINK = """WITH l AS (SELECT DISTINCT label FROM (SELECT unnest(regexp_split_to_array(substr(text, 1, 80), '\\s+')) AS label FROM documents) WHERE length(label) >= 6),
n AS (SELECT conv_id || ':' || turn AS note_id, text FROM conversations), h AS (SELECT note_id, string_agg(label, ',' ORDER BY label) AS e FROM n JOIN l ON contains(text, label) GROUP BY note_id)
SELECT note_id, coalesce(e, '') AS entities FROM n LEFT JOIN h USING (note_id)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, and a batch of half of them: unchanged, updated or new by id."""
    c = tables.chunks(spark, d).select("chunk_id", "slot", "title", "text")
    batch = c.where("slot % 2 = 0").select(F.when(F.col("slot") % 6 == 4, F.concat("chunk_id", F.lit("-new"))).otherwise(F.col("chunk_id")).alias("chunk_id"), "title", F.when(F.col("slot") % 6 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    return c, batch


def upsert_result_counts(spark: SparkSession, d: str) -> DataFrame:
    c, batch = versions(spark, d)
    return mutation.result(mutation.compare(c, batch))


UPSERT_COUNTS = "SELECT sum(CASE WHEN doc_id % 6 = 4 THEN 1 ELSE 0 END)::BIGINT AS inserted, sum(CASE WHEN doc_id % 6 = 2 THEN 1 ELSE 0 END)::BIGINT AS updated, sum(CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END)::BIGINT AS unchanged, true AS changed FROM documents WHERE text <> '' AND doc_id % 2 = 0"


def upsert_slots(spark: SparkSession, d: str) -> DataFrame:
    c, batch = versions(spark, d)
    mutation.validate(batch)
    top = c.agg(F.max("slot")).first()[0] + 1
    return mutation.upsert(c, batch, top).select("chunk_id", F.col("slot").cast("long").alias("slot"), F.length("text").cast("long").alias("size"))


UPSERT_SLOTS = """WITH c AS (SELECT 'd' || doc_id AS chunk_id, doc_id AS slot, text FROM documents WHERE text <> ''),
b AS (SELECT CASE WHEN slot % 6 = 4 THEN chunk_id || '-new' ELSE chunk_id END AS chunk_id, CASE WHEN slot % 6 = 2 THEN text || ' more' ELSE text END AS text FROM c WHERE slot % 2 = 0),
x AS (SELECT b.chunk_id, (SELECT max(slot) FROM c) + row_number() OVER (ORDER BY b.chunk_id) AS slot, text FROM b WHERE b.chunk_id LIKE '%-new')
SELECT c.chunk_id, c.slot, CAST(length(coalesce(b.text, c.text)) AS BIGINT) AS size FROM c LEFT JOIN b ON b.chunk_id = c.chunk_id UNION ALL SELECT chunk_id, CAST(slot AS BIGINT), CAST(length(text) AS BIGINT) FROM x"""


def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    c = versions(spark, d)[0]
    ids = c.where("slot % 3 = 0").select("chunk_id").unionByName(c.where("slot % 10 = 0").select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id")))
    return mutation.delete_result(c, ids)


DELETE_COUNTS = "SELECT sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS deleted, sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS missing FROM documents WHERE text <> ''"


def overlay_postings(spark: SparkSession, d: str) -> DataFrame:
    c = tables.chunks(spark, d)
    base = lexical.postings(lexical.tokenized(c))
    changed = c.where("slot % 7 = 0").withColumn("text", F.concat("text", F.lit(" zzadded")))
    both = mutation.overlay(base, changed.select("slot"), lexical.postings(lexical.tokenized(changed)))
    return both.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf_body").alias("tf"))


OVERLAY = f"""WITH docs AS (SELECT doc_id AS slot, {sql.tok('substr(text, 1, 80)')} AS t, {sql.tok("text || CASE WHEN doc_id % 7 = 0 THEN ' zzadded' ELSE '' END")} AS b FROM documents WHERE text <> ''), {sql.POSTINGS}
SELECT term, count(*) AS df, CAST(sum(tf_body) AS BIGINT) AS tf FROM post GROUP BY term"""


def df_after_delete(spark: SparkSession, d: str) -> DataFrame:
    base = lexical.postings(lexical.tokenized(tables.chunks(spark, d)))
    gone = base.where("slot % 4 = 1")
    return mutation.apply_deltas(lexical.term_stats(base), mutation.term_deltas(gone, gone.limit(0))).select("term", "df")


DF_AFTER_DELETE = f"WITH {sql.DOCS}, {sql.POSTINGS} SELECT term, count(*) AS df FROM post WHERE slot % 4 <> 1 GROUP BY term"


def cdc_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the corpus after each phase of a trace of disjoint, hash-ordered groups."""
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("key"))
    groups = mutation.hash_groups(rows, "trace", {"insert": 40, "update": 40, "delete": 40, "noop": 40}, "key")
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("ids"))


CDC = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('trace|' || doc_id), doc_id) AS r FROM documents)
SELECT CASE WHEN r <= 40 THEN 'insert' WHEN r <= 80 THEN 'update' WHEN r <= 120 THEN 'delete' ELSE 'noop' END AS "group", count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM r WHERE r <= 160 GROUP BY ALL"""


def mode_counters(spark: SparkSession, d: str) -> DataFrame:
    return mutation.modes(tables.chunks(spark, d))


MODE_COUNTERS = "SELECT count(*) AS chunks, count(*) AS titled, count(*) AS lexical, CAST(0 AS BIGINT) AS embedded, false AS dense_mode, count(*) > 0 AS fielded_mode FROM documents WHERE text <> ''"


def stream_store(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of upserts and deletes of users' chunks; the store's last version."""
    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    log = tables.read(spark, d, "events").select(F.col("event_id").alias("op_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chunk_id"), F.col("event_type").alias("title"), F.round("value", 3).cast("string").alias("text"))
    log.write.parquet(f"{at}/log")
    store = changes.ChunkStore(spark, f"{at}/store")
    store.follow(spark.readStream.schema(log.schema).parquet(f"{at}/log"), f"{at}/checkpoint").awaitTermination()
    return store.current.select("chunk_id", "title")


STREAM_STORE = """WITH r AS (SELECT 'u' || user_id AS chunk_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT chunk_id, event_type AS title FROM r WHERE r = 1 AND event_type <> 'error'"""


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return changes.windowed_counts(tables.read(spark, d, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", R6("total").alias("total"))


WINDOWED = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def ranked(spark: SparkSession, d: str, fielded: bool = True, counts: lexical.Counted | None = None) -> DataFrame:
    hits = lexical.best(lexical.texts(tables.chunks(spark, d)), tables.questions(spark, d), 20, fielded=fielded, counts=counts)
    return kept(hits.select("query_id", F.col("slot").alias("doc"), "rank"), "ranked")


def counts(spark: SparkSession, d: str) -> lexical.Counted | None:
    """Counts of the questions' terms, for rankings of more than one kind."""
    return lexical.counted(lexical.texts(tables.chunks(spark, d)), tables.questions(spark, d))


def per_query(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.per_query(ranked(spark, d), tables.qrels(spark, d), 10)
    return rows.select("query_id", *[R6(c).alias(c) for c in ("precision", "recall", "f1", "rr", "ndcg")], "solved")


def metric_ctes(source: str, name: str = "m") -> str:
    return f"""need_{name} AS (SELECT query_id, count(DISTINCT doc) AS rel FROM qrels GROUP BY query_id),
j_{name} AS (SELECT n.query_id, rel, rank, CASE WHEN q.doc IS NOT NULL THEN 1 ELSE 0 END AS hit FROM need_{name} n LEFT JOIN {source} p ON p.query_id = n.query_id LEFT JOIN qrels q ON q.query_id = n.query_id AND q.doc = p.slot),
a_{name} AS (SELECT query_id, rel, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS returned, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 AND hit = 1 THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg FROM j_{name} GROUP BY ALL),
{name} AS (SELECT query_id, CASE WHEN returned > 0 THEN hits / returned ELSE 0.0 END AS "precision", hits / rel AS recall, coalesce(1.0 / first, 0.0) AS rr,
  dcg / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg, hits = rel AS solved FROM a_{name})"""


F1 = 'CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END'
PER_QUERY = f'WITH {sql.BM25F}, {sql.top("scores", 20)}, {sql.QRELS}, {metric_ctes("pool")} SELECT query_id, round(CAST("precision" AS DOUBLE), 6) AS "precision", round(CAST(recall AS DOUBLE), 6) AS recall, round(CAST({F1} AS DOUBLE), 6) AS f1, round(CAST(rr AS DOUBLE), 6) AS rr, round(CAST(ndcg AS DOUBLE), 6) AS ndcg, solved FROM m'


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.summary(metrics.per_query(ranked(spark, d), tables.qrels(spark, d), 10))
    return rows.select("total", *[R6(c).alias(c) for c in ("precision", "recall", "f1", "rr", "ndcg")], "solved")


SUMMARY = f'WITH {sql.BM25F}, {sql.top("scores", 20)}, {sql.QRELS}, {metric_ctes("pool")} SELECT count(*) AS total, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg({F1}), 6) AS f1, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, CAST(sum(CASE WHEN solved THEN 1 ELSE 0 END) AS BIGINT) AS solved FROM m'


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    q, c = tables.qrels(spark, d), counts(spark, d)
    return metrics.head_to_head(metrics.per_query(ranked(spark, d, True, c), q), metrics.per_query(ranked(spark, d, False, c), q), "rr")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.turn_pairs(tables.read(spark, d, "conversations"))
    return rows.select("conv_id", F.col("pair").cast("int").alias("pair"), F.substring("user", 1, 80).alias("title"), F.sha2(F.concat_ws("|", "user", "assistant"), 256).alias("pair_sha256"))


TURN_PAIRS = """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lag(role) OVER w AS lr FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS u, CASE WHEN role = 'user' THEN (CASE WHEN nr = 'assistant' THEN nt ELSE '' END) ELSE text END AS a FROM t
  WHERE role = 'user' OR (coalesce(lr, '') <> 'user' AND trim(text) <> ''))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pair, substr(u, 1, 80) AS title, sha256(u || '|' || a) AS pair_sha256 FROM k"""


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.percentiles(tables.read(spark, d, "events"), "value", "event_type")
    return rows.select("event_type", "n", *[R6(c).alias(c) for c in ("mean", "p50", "p95")])


PERCENTILES = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


def preprocessing(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation rule itself: titles of 80 characters, bodies of 2,000."""
    x = tables.read(spark, d, "documents").where("text <> ''")
    return x.select("doc_id", F.substring("text", 1, 80).alias("title"), F.sha2(F.substring("text", 1, 2000), 256).alias("body_sha256"))


PREPROCESSING = "SELECT doc_id, substr(text, 1, 80) AS title, sha256(substr(text, 1, 2000)) AS body_sha256 FROM documents WHERE text <> ''"


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Balanced sample: of each language the ten documents of the smallest seeded hash."""
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("seed|"), F.col("doc_id").cast("string")), 256))
    return tables.read(spark, d, "documents").select("doc_id", "lang").withColumn("r", F.row_number().over(w)).where("r <= 10")


HASH_SAMPLE = "SELECT doc_id, lang, CAST(r AS INTEGER) AS r FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed|' || doc_id)) AS r FROM documents) WHERE r <= 10"


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as an answer to the one before it: correctness, and support of its first words."""
    from ..functions import text

    t = tables.read(spark, d, "conversations")
    rows = t.withColumn("gold", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("gold IS NOT NULL")
    return rows.select("conv_id", "turn", R6(text.answer_correctness("text", "gold")).alias("correctness"), R6(text.context_support(text.truncate_words("text"), "gold")).alias("support"))


QUERIES = {
    "feedback_bm25f": (feedback_bm25f, FEEDBACK_BM25F),
    "evidence_only_idf": (evidence_only_idf, EVIDENCE_IDF),
    "feedback_text": (feedback_text, FEEDBACK_TEXT),
    "vault_salience": (vault_salience, VAULT_SALIENCE),
    "vault_autolink": (vault_autolink, VAULT_AUTOLINK),
    "upsert_result_counts": (upsert_result_counts, UPSERT_COUNTS),
    "upsert_slots": (upsert_slots, UPSERT_SLOTS),
    "delete_counts": (delete_counts, DELETE_COUNTS),
    "overlay_postings": (overlay_postings, OVERLAY),
    "df_after_delete": (df_after_delete, DF_AFTER_DELETE),
    "cdc_checkpoints": (cdc_checkpoints, CDC),
    "mode_counters": (mode_counters, MODE_COUNTERS),
    "stream_store": (stream_store, STREAM_STORE),
    "windowed_events": (windowed_events, WINDOWED),
    "precision_recall_ndcg": (per_query, PER_QUERY),
    "metric_summary": (metric_summary, SUMMARY),
    "head_to_head": (head_to_head, None),
    "turn_pairs": (turn_pairs, TURN_PAIRS),
    "latency_percentiles": (latency_percentiles, PERCENTILES),
    "document_preprocessing": (preprocessing, PREPROCESSING),
    "hash_sample": (hash_sample, HASH_SAMPLE),
    "answer_scores": (answer_scores, None),
}
