"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_dedup, decontam, langid, near_dedup, packing, secrets, sharding, suffix_dedup, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = block_dedup.dedup_words(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(a, i, i + 34), ' ')) AS h
      FROM (SELECT doc_id, a, unnest(range(1, len(a) - 33)) AS i FROM w WHERE len(a) >= 35)),
d AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM s WHERE h IN (SELECT h FROM d) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(a) AS n_words, coalesce(len(gone), 0) AS n_removed,
             list_filter(a, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return done.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = langid.identify(table(spark, sf_dir, "documents"))
    return done.select("doc_id", langid.held_out("doc_id", 5).alias("held_out"), F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.cross_entropy").alias("cross_entropy"), F.col("language.accepted").alias("accepted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.col("toxicity.predicted").alias("predicted"),
        F.array_join(F.transform("toxicity.evidence", lambda e: F.concat_ws(":", e["example"].cast("string"), e["label"].cast("string"))), ",").alias("evidence"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontam": op2_decontam,
    "op3_topk": op3_topk,
    "op4_block_dedup": op4_block_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op4_block_dedup": OP4_SQL}
