"""Views of the standard tables as chunks, questions, judgements and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.containment import contained
from .scratch import kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: whole texts, titled by their first 80 characters."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("slot"),
        F.substring("text", 1, 80).alias("title"),
        "text",
        F.array(F.concat(F.lit("src:"), "source"), F.concat(F.lit("lang:"), "lang")).alias("entities"),
        F.lit(None).cast("array<double>").alias("embedding"),
        F.to_json(F.struct("source", "lang")).alias("meta"),
    )


def questions(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit(prefix), "text").alias("question"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc): documents that hold the passage word for word."""
    q = questions(spark, sf_dir).select(F.col("query_id").alias("pattern_id"), F.col("question").alias("pattern"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return kept(contained(d, q).select(F.col("pattern_id").alias("query_id"), F.col("text_id").alias("doc")), "qrels")


def chunk_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A node for each chunk; each points to the next document of its source, and is of its language's class."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "source", "lang", "text")
    nodes = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.substring("text", 1, 80).alias("label"), F.lit("instance").alias("kind"), F.col("doc_id").alias("pos"))
    follow = d.withColumn("next", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))).where("next IS NOT NULL")
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    return nodes, follow.select(F.col("doc_id").alias("pos"), name("doc_id").alias("s"), F.lit("next").alias("p"), name("next").alias("o"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, s, p, o): parts and their types, customers, suppliers, nations, regions and orders."""
    t = lambda name: read(spark, sf_dir, name)
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    row = lambda df, base, at, s, p, o: df.select((F.lit(base * 10**9) + F.col(at).cast("long")).alias("pos"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    out = row(t("part"), 0, "p_partkey", key("p:", "p_partkey"), "instanceOf", key("t:", "p_type"))
    out = out.unionByName(row(t("customer"), 1, "c_custkey", key("c:", "c_custkey"), "instanceOf", key("m:", "c_mktsegment")))
    out = out.unionByName(row(t("customer"), 2, "c_custkey", key("c:", "c_custkey"), "locatedIn", key("n:", "c_nationkey")))
    out = out.unionByName(row(t("supplier"), 3, "s_suppkey", key("s:", "s_suppkey"), "locatedIn", key("n:", "s_nationkey")))
    out = out.unionByName(row(t("nation"), 4, "n_nationkey", key("n:", "n_nationkey"), "partOf", key("r:", "n_regionkey")))
    return out.unionByName(row(t("orders"), 5, "o_orderkey", key("o:", "o_orderkey"), "placedBy", key("c:", "o_custkey")))


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    row = lambda df, tag, key, name: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("node_id"), F.col(name).alias("label"))
    out = row(t("part"), "p:", "p_partkey", "p_name").unionByName(row(t("customer"), "c:", "c_custkey", "c_name")).unionByName(row(t("supplier"), "s:", "s_suppkey", "s_name"))
    return out.unionByName(row(t("nation"), "n:", "n_nationkey", "n_name")).unionByName(row(t("region"), "r:", "r_regionkey", "r_name"))
