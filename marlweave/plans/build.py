"""Engines from tables, from loose edges, and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import graph, linking, mutation, numbering
from ..sources import readers
from .engine import Engine


def new_edges(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """The derived (s, p, o) that are no edges yet, numbered after them: pos, s, p, o."""
    last = edges.agg(F.max("pos")).first()[0]
    fresh = derived.select("s", "p", "o").distinct().join(edges.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return numbering.numbered(fresh, ["s", "p", "o"], "pos", 0 if last is None else last + 1).select("pos", "s", "p", "o")


def with_chunk_nodes(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes, and one for each chunk that is none yet, named by its title or else its id."""
    last = nodes.agg(F.max("pos")).first()[0]
    fresh = chunks.select(F.col("chunk_id").alias("node_id"), F.coalesce(F.nullif("title", F.lit("")), "chunk_id").alias("label"), "slot").join(nodes.select("node_id"), "node_id", "left_anti")
    fresh = fresh.select("node_id", "label", F.lit("instance").alias("kind"), (F.col("slot") + (0 if last is None else last + 1)).alias("pos"))
    return nodes.select("node_id", "label", "kind", "pos").unionByName(fresh)


def build(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, memory: DataFrame | None = None, config: Config = DEFAULT, auto_link_titles: bool = False) -> Engine:
    """An engine over tables. With ``auto_link_titles`` chunks are nodes too, with an edge wherever
    one mentions another's unambiguous title. memory: slot, query, seq."""
    if auto_link_titles:
        nodes = with_chunk_nodes(nodes, chunks)
        edges = edges.select("pos", "s", "p", "o").unionByName(new_edges(edges, linking.title_links(chunks)))
    return Engine(chunks, nodes, edges, memory, config, mutation.is_fielded(chunks, memory is not None))


def no_chunks(spark: SparkSession) -> DataFrame:
    return readers.read_chunks_jsonl(spark, None)


def from_edges(edges: DataFrame, chunks: DataFrame | None = None, nodes: DataFrame | None = None, labels: DataFrame | None = None, **how) -> Engine:
    """Nodes are derived from the edges where none are given, or an empty table."""
    chunks = no_chunks(edges.sparkSession) if chunks is None else chunks
    if nodes is None or not nodes.limit(1).count():
        nodes = graph.derive_nodes(edges, labels)
    return build(nodes, edges, chunks, **how)


def from_jsonl(spark: SparkSession, edges: str | None = None, chunks: str | None = None, nodes: str | None = None, **how) -> Engine:
    """One object a line; a path left out gives no rows."""
    known = readers.read_nodes_jsonl(spark, nodes) if nodes else None
    return from_edges(readers.read_edges_jsonl(spark, edges), readers.read_chunks_jsonl(spark, chunks), known, **how)


def from_csv(spark: SparkSession, edges: str | None = None, chunks: str | None = None, **how) -> Engine:
    table = readers.read_edges_csv(spark, edges) if edges else readers.read_edges_jsonl(spark, None)
    return from_edges(table, readers.read_chunks_csv(spark, chunks) if chunks else None, **how)
