"""Readers and coercion of chunks, edges and nodes."""

from __future__ import annotations

from collections.abc import Iterable
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_CHUNKS = "id string, title string, text string, entities array<string>, embedding array<double>, meta map<string,string>"


def filled(*columns: str):
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def numbered(df: DataFrame, order: str = "pos") -> DataFrame:
    """Adds ``order``: rising in the order of rows as read; not dense."""
    return df.withColumn(order, F.monotonically_increasing_id())


def read_chunks_jsonl(spark: SparkSession, path: str | None) -> DataFrame:
    """One object a line; no path gives no rows. Missing titles, texts and entities are empty."""
    rows = spark.read.schema(JSON_CHUNKS).json(path) if path else spark.createDataFrame([], JSON_CHUNKS)
    empty = F.array().cast("array<string>")
    return numbered(rows.where("id IS NOT NULL"), "slot").select(
        F.col("id").alias("chunk_id"), "slot", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("entities", empty).alias("entities"), "embedding", F.to_json(F.coalesce("meta", F.create_map().cast("map<string,string>"))).alias("meta")
    )


def read_edges_jsonl(spark: SparkSession, path: str | None) -> DataFrame:
    rows = spark.read.schema("s string, p string, o string").json(path) if path else spark.createDataFrame([], "s string, p string, o string")
    return numbered(rows.where("s <> '' AND p <> '' AND o <> ''"))


def read_nodes_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; a missing label is the id, a missing kind is instance."""
    rows = spark.read.schema("id string, label string, kind string").json(path).where("id IS NOT NULL")
    return numbered(rows).select(F.col("id").alias("node_id"), F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("instance")).alias("kind"), "pos")


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns s, p, o, or subject, predicate, object where those are missing or empty; incomplete rows go."""
    rows = spark.read.option("header", True).csv(path)
    for c in ("s", "p", "o", "subject", "predicate", "object"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    out = rows.select(filled("s", "subject").alias("s"), filled("p", "predicate").alias("p"), filled("o", "object").alias("o"))
    return numbered(out.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"))


def read_chunks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns id, text and entities separated by '|'; there are no titles."""
    rows = numbered(spark.read.option("header", True).option("multiLine", True).csv(path), "slot")
    entities = F.filter(F.split(F.coalesce("entities", F.lit("")), "\\|"), lambda e: e != "") if "entities" in rows.columns else F.array().cast("array<string>")
    return rows.select(F.col("id").alias("chunk_id"), "slot", F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"), entities.alias("entities"), F.lit(None).cast("array<double>").alias("embedding"), F.lit("{}").alias("meta"))


def edge(t: Any) -> tuple[str, str, str]:
    if isinstance(t, dict):
        return itemgetter("s", "p", "o")(t)
    return tuple(getattr(t, c) for c in "spo") if hasattr(t, "s") else tuple(t)


def chunk(c: Any) -> tuple:
    """(id, title, text, entities, embedding, meta) of a mapping, an object or (id[, text[, entities]])."""
    if isinstance(c, (tuple, list)):
        c = dict(zip(("id", "text", "entities"), c))
    get = (lambda k, d: c.get(k, d)) if isinstance(c, dict) else (lambda k, d: getattr(c, k, d))
    if get("id", None) is None:
        raise ValueError("a chunk needs an id")
    return get("id", None), get("title", "") or "", get("text", "") or "", list(get("entities", []) or []), get("embedding", None), {k: str(v) for k, v in (get("meta", {}) or {}).items()}


def node(n: Any) -> tuple[str, str, str]:
    if isinstance(n, (tuple, list)):
        n = dict(zip(("id", "label", "kind"), n))
    get = (lambda k, d: n.get(k, d)) if isinstance(n, dict) else (lambda k, d: getattr(n, k, d))
    return get("id", None), get("label", None) or get("id", None), get("kind", None) or "instance"


def chunks_of(spark: SparkSession, items: Iterable[Any]) -> DataFrame:
    rows = [(i[0], n, *i[1:]) for n, i in enumerate(map(chunk, items))]
    out = spark.createDataFrame(rows, "chunk_id string, slot long, title string, text string, entities array<string>, embedding array<double>, meta map<string,string>")
    return out.withColumn("meta", F.to_json("meta"))


def edges_of(spark: SparkSession, items: Iterable[Any]) -> DataFrame:
    return spark.createDataFrame([(n, *edge(t)) for n, t in enumerate(items)], "pos long, s string, p string, o string")


def nodes_of(spark: SparkSession, items: Iterable[Any]) -> DataFrame:
    return spark.createDataFrame([(*node(x), n) for n, x in enumerate(items)], "node_id string, label string, kind string, pos long")
