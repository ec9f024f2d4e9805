"""Fusion of ranked chunks with the graph, adaptive cuts, diversity and relation ranking."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.text import query_tokens, tokens
from ..sources.scratch import kept
from . import graph, lexical, scoring
from .containment import bounded, only


def with_title_seeds(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, stage, pos): a mentioned title's chunk is lifted above the best hit.

    hits: query_id, chunk_id, score, rank. Questions without a hit get no seeds.
    """
    top = hits.where("rank = 1").select("query_id", F.col("score").alias("top"))
    lifted = seeds.join(top, "query_id").select("query_id", "chunk_id", (F.col("top") * (1.0 + 0.2 - 0.08 * F.least(F.lit(1.0), F.col("offset") / F.col("words")) + 0.02 * F.col("affinity"))).alias("lift"), "label_rank")
    lifted = lifted.groupBy("query_id", "chunk_id").agg(F.max("lift").alias("lift"), F.min("label_rank").alias("label_rank"))
    both = hits.select("query_id", "chunk_id", "score", "rank").join(lifted, ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.greatest("score", "lift").alias("score"), F.when(F.col("rank").isNull(), 1).otherwise(0).alias("stage"), F.coalesce("rank", "label_rank").cast("long").alias("pos"))


def with_companions(scored: DataFrame, edges: DataFrame, chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks that the best ones point to get a share of their score, if that is more than their own."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "stage", "pos", "chunk_id")
    seeds = scored.withColumn("seed", F.row_number().over(w)).where(F.col("seed") <= config.fusion_expand_top).select("query_id", F.col("chunk_id").alias("node"), F.col("score").alias("from_score"), "seed")
    near = graph.neighbor_ids(edges, seeds.select("node"), config.fusion_neighbor_limit, config.fusion_direction)
    reached = seeds.join(near, "node").join(chunks.select(F.col("chunk_id").alias("other")), "other")
    best = reached.groupBy("query_id", F.col("other").alias("chunk_id")).agg(F.max(config.fusion_alpha * F.col("from_score")).alias("lift"), F.min(F.struct("seed", "pos")).alias("first"))
    both = scored.join(best, ["query_id", "chunk_id"], "full")
    place = F.col("first.seed").cast("long") * F.lit(1 << 40) + F.col("first.pos")
    return both.select("query_id", "chunk_id", F.greatest("score", "lift").alias("score"), F.coalesce("stage", F.lit(2)).alias("stage"), F.coalesce("pos", place).alias("pos"))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "stage", "pos", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "rank")


def dynamic_cut(hits: DataFrame, ratio: float = DEFAULT.sem_ratio, min_k: int = DEFAULT.sem_min, max_k: int = DEFAULT.sem_max) -> DataFrame:
    """Hits of at least ``ratio`` of the first one's score, at most ``max_k``; the first ``min_k`` if they are fewer."""
    w = Window.partitionBy("query_id")
    top = F.coalesce(F.nullif(F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w), F.lit(0.0)), F.lit(1e-9))
    rows = hits.withColumn("good", F.col("score") >= ratio * top)
    nth = F.sum(F.col("good").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("keep", F.col("good") & (nth <= max_k))
    rows = rows.withColumn("n", F.sum(F.col("keep").cast("int")).over(w))
    return rows.where(F.when(F.col("n") < min_k, F.col("rank") <= min_k).otherwise(F.col("keep"))).drop("good", "keep", "n")


def mmr(candidates: DataFrame, lam: float = DEFAULT.mmr_lambda, k: int = DEFAULT.evidence_k) -> DataFrame:
    """(query_id, pick, rank, text): greedy choice of relevant texts unlike those chosen already.

    candidates: query_id, rank, score, text; the frontier of a question, so a group is small.
    """
    rows = candidates.select("query_id", "rank", "score", "text", F.array_distinct(tokens("text")).alias("t"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        sets = [set(t) for t in group["t"]]
        top = max(group["score"]) or 1.0
        near, left, out = [0.0] * len(group), list(range(len(group))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (lam * (group["score"][i] / top) - (1 - lam) * near[i], -i))
            left.remove(best)
            out.append(best)
            for i in left:
                a, b = sets[i], sets[best]
                both = len(a & b)
                near[i] = max(near[i], both / (len(a) + len(b) - both) if a and b else 0.0)
        return pd.DataFrame({"query_id": group["query_id"][out].to_numpy(), "pick": range(1, len(out) + 1), "rank": group["rank"][out].to_numpy(), "text": group["text"][out].to_numpy()})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, pick int, rank int, text string")


def _met_relations(once: DataFrame, asked: DataFrame, limit: int) -> DataFrame | None:
    """(query_id, relation, hits, pos): of each question the first ``limit`` relations with a hit, counted where a relation lies.

    None where places repeat, or terms or the limit are too many for a task.
    """
    if not 0 < limit <= scoring.MOST or asked.limit(scoring.ASKED + 1).count() > scoring.ASKED or asked.select("term").distinct().count() > scoring.TERMS:
        return None
    each: dict = {}
    for r in asked.orderBy("query_id", "term").collect():  # counted
        each.setdefault(r["query_id"], []).append(r["term"])
    terms = sorted({t for own in each.values() for t in own})
    place = {t: i for i, t in enumerate(terms)}
    rows = kept(scoring.of_texts(lexical.searched(once.select(F.col("pos").alias("slot"), F.lit("").alias("title"), F.col("relation").alias("text"), F.lit("").alias("said"))), terms), "counted")
    if not each or scoring.repeats(rows):
        return None
    every, kind = [(q, [(place[t], 1) for t in own]) for q, own in each.items()], asked.schema["query_id"].dataType
    found = [scoring.hits(rows, scoring.Presence(), every[i : i + scoring.QUESTIONS], kind, set(), limit) for i in range(0, len(every), scoring.QUESTIONS)]
    best = kept(lexical.top_k(reduce(DataFrame.unionByName, found).select("query_id", "slot", "score"), limit), "met")
    named = only(once.select(F.col("pos").alias("slot"), "relation"), best, "slot")
    return best.join(named, "slot").select("query_id", "relation", F.col("score").cast("int").alias("hits"), F.col("slot").alias("pos"))


def rank_shared_relations(relations: DataFrame, queries: DataFrame, limit: int = DEFAULT.rel_limit) -> DataFrame:
    """``rank_relations`` where all questions choose from the same relations (relation, pos).

    Questions meet relations by their terms; the first ones in order fill up lists with too few hits.
    """
    once = kept(relations.groupBy("relation").agg(F.min("pos").alias("pos")), "relations")
    asked = kept(queries.select("query_id", F.explode(F.array_distinct(query_tokens("question"))).alias("term")), "asked-terms")
    met = _met_relations(once, asked, limit)
    if met is None:
        met = once.select("relation", "pos", F.explode(F.array_distinct(tokens("relation"))).alias("term")).join(bounded(asked), "term").groupBy("query_id", "relation").agg(F.count(F.lit(1)).cast("int").alias("hits"), F.first("pos").alias("pos"))
    # of the first 2 * limit at least limit have no hit, if fewer than limit have one
    first = once.orderBy("pos", "relation").limit(2 * limit)
    rows = met.unionByName(queries.select("query_id").crossJoin(F.broadcast(first)).select("query_id", "relation", F.lit(0).alias("hits"), "pos"))
    rows = rows.groupBy("query_id", "relation").agg(F.max("hits").alias("hits"), F.first("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "relation", "hits", "rank")


def rank_relations(relations: DataFrame, queries: DataFrame, limit: int = DEFAULT.rel_limit) -> DataFrame:
    """(query_id, relation, hits, rank): distinct relations by the question's terms they hold, then first sight.

    relations: query_id, relation, pos.
    """
    once = relations.groupBy("query_id", "relation").agg(F.min("pos").alias("pos"))
    asked = queries.select("query_id", F.array_distinct(query_tokens("question")).alias("q"))
    rows = once.join(asked, "query_id").withColumn("hits", F.size(F.array_intersect("q", tokens("relation"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "relation", "hits", "rank")
