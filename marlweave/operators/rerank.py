"""Reranking of a small frontier on phrase and surface evidence, and dense and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.text import is_personal, pairs, query_tokens, surface_score, tokens
from ..functions.vectors import minmax
from ..sources.scratch import kept
from . import dense, lexical
from .containment import only


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, slot, score, rank): phrase order for all questions, fused scores for personal ones.

    Ordinary questions keep their scores and only change order; questions of fewer than three
    terms or with one hit stay as they are. For questions about the speaker the two ranks (phrase, surface)
    are fused by their inverses and become the score.
    """
    w = Window.partitionBy("query_id")
    asked = queries.select("query_id", "question", query_tokens("question").alias("q"), is_personal("question").alias("personal"))
    # only the frontier meets the texts, and each text is tokenized once
    near = only(chunks.select("slot", "title", "text"), ranked, "slot")
    near = kept(near.withColumn("line", F.concat(F.lit(" "), F.array_join(tokens(F.concat_ws(" ", "title", "text")), " "), F.lit(" "))), "frontier-texts")
    rows = ranked.join(asked, "query_id").join(near, "slot")
    rows = rows.withColumn("top", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w)).withColumn("hits", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("open", (F.col("hits") >= 2) & (F.size("q") >= 3))
    # tokens hold no blank, so a pair stands in the line of tokens if and only if the two are neighbours
    rows = rows.withColumn("q_pairs", pairs(F.col("q")))
    both = F.size(F.filter("q_pairs", lambda p: F.col("line").contains(F.concat(F.lit(" "), p, F.lit(" ")))))
    fraction = F.when(F.size("q_pairs") == 0, F.lit(0.0)).otherwise(both / F.size("q_pairs"))
    rows = rows.withColumn("lifted", F.when(F.col("open"), F.round(F.col("score") + F.col("top") * 0.5 * fraction, 9)).otherwise(F.col("score")))
    by_phrase = Window.partitionBy("query_id").orderBy(F.when(~F.col("open"), F.col("rank")), F.desc("lifted"), "slot")
    rows = rows.withColumn("phrase", F.row_number().over(by_phrase))
    rows = rows.withColumn("surface_score", F.when(F.col("personal") & F.col("open"), surface_score("question", "title", "text")).otherwise(0.0))
    by_surface = Window.partitionBy("query_id").orderBy(F.desc("surface_score"), "phrase")
    rows = rows.withColumn("fused", F.lit(0.4) / F.col("phrase") + F.lit(0.6) / F.row_number().over(by_surface))
    rows = rows.withColumn("fused", F.round(F.col("top") * F.col("fused") / F.max("fused").over(w), 9))
    fuse = F.col("personal") & F.col("open")
    rows = rows.withColumn("score", F.when(fuse, F.col("fused")).otherwise(F.col("score")))
    final = Window.partitionBy("query_id").orderBy(F.when(fuse, -F.col("score")), F.when(fuse, F.col("slot")), "phrase")
    return rows.withColumn("rank", F.row_number().over(final)).select("query_id", "slot", "score", "rank")


def lexical_search(chunks: DataFrame, queries: DataFrame, limit: int, config: Config = DEFAULT, memory: DataFrame | None = None, fielded: bool = True, rerank_hits: bool = True, index: lexical.Index | DataFrame | None = None) -> DataFrame:
    """The lexical contract: frontier, coordination, Korean fallback, rerank, cut. ``index`` is what stands for the chunks, if not their texts."""
    index = lexical.texts(chunks, memory) if index is None else index
    pool = kept(lexical.best(index, queries, max(limit, config.pool), config, fielded, coordinated=True), "frontier")
    without = queries.join(pool.select("query_id").distinct(), "query_id", "left_anti").where(F.col("question").rlike("[가-힣]"))
    if without.limit(1).count():
        pool = kept(pool.unionByName(lexical.korean_fallback(chunks, without, max(limit, config.pool), config).select("query_id", "slot", "score", "rank")), "frontier")
    out = rerank(pool, queries, chunks) if rerank_hits else pool
    return out.where(F.col("rank") <= limit)


def dense_search(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, slot, score, rank) by exact cosine; negative ones are hits too. queries: query_id, embedding.

    Each question meets every chunk, by products of blocks (see ``dense``); only the best hits leave a task.
    """
    return dense.search(chunks, queries, limit)


def hybrid(dense: DataFrame, lexical_hits: DataFrame, limit: int, config: Config = DEFAULT) -> DataFrame:
    """Weighted sum of both lists after each is put on [0, 1]; a chunk missing from a list has 0 there."""
    d = dense.select("query_id", "slot", minmax("score").alias("dense"))
    x = lexical_hits.select("query_id", "slot", minmax("score").alias("lexical"))
    both = d.join(x, ["query_id", "slot"], "full").select("query_id", "slot", (config.dense_weight * F.coalesce("dense", F.lit(0.0)) + config.lexical_weight * F.coalesce("lexical", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
