"""Retrieval metrics over rankings and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc, rank, hit, relevant): every ranked document of a judged question; questions without hits keep a row."""
    need = qrels.groupBy("query_id").agg(F.count_distinct("doc").alias("relevant"))
    hits = ranked.select("query_id", "doc", "rank").join(qrels.select("query_id", "doc", F.lit(1).alias("hit")).distinct(), ["query_id", "doc"], "left")
    return need.join(hits, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """precision (over what is returned), recall, f1, rr (over the whole list), ndcg and solved of each question."""
    top = F.col("rank") <= k
    gain = lambda r: 1.0 / F.log2(r + 1.0)
    rows = judged(ranked, qrels).groupBy("query_id", "relevant").agg(
        F.count(F.when(top, 1)).alias("returned"),
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("hit") == 1), gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i.cast("double")))
    p = F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)
    r = F.col("hits") / F.col("relevant")
    return rows.select(
        "query_id",
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("hits") == F.col("relevant")).alias("solved"),
    )


def _gain(rank):
    return 1.0 / F.log2(rank + 1.0)


def _ideal(many):
    """DCG of so many hits in the first places."""
    return F.aggregate(F.when(many > 0, F.sequence(F.lit(1), many.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + _gain(i.cast("double")))


def once(ranked: DataFrame) -> DataFrame:
    """(query_id, doc, rank) with each document at its first place, and ranks without gaps."""
    first = ranked.groupBy("query_id", "doc").agg(F.min("rank").alias("r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "doc"))).drop("r")


def end_to_end(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of the first ``k`` different documents, with precision over k, whether any and all were hit."""
    top = once(ranked).where(F.col("rank") <= k)
    rows = judged(top, qrels).groupBy("query_id", F.col("relevant").alias("gold")).agg(
        F.count("rank").alias("retrieved"), F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, _gain(F.col("rank"))).otherwise(0.0)).alias("dcg")
    )
    p, r = F.col("hits") / F.lit(k), F.col("hits") / F.col("gold")
    return rows.select(
        "query_id", "retrieved", "gold", "hits", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.col("hits") > 0).alias("hit"), (F.col("hits") == F.col("gold")).alias("all_gold"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / _ideal(F.least("gold", F.lit(k)))).alias("ndcg"),
    )


def sessions(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Metrics over different sessions: the ideal has as many hits as there are gold sessions, but no more than were retrieved.

    Questions without gold sessions are not eligible and have no values.
    """
    found = once(ranked)
    gold = qrels.select("query_id", "doc").distinct()
    have = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    got = found.join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, _gain(F.col("rank"))).otherwise(0.0)).alias("dcg")
    )
    rows = got.join(have, "query_id", "full").withColumns({"gold": F.coalesce("gold", F.lit(0)), "retrieved": F.coalesce("retrieved", F.lit(0)), "hits": F.coalesce("hits", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0))})
    best = F.least("gold", "retrieved")
    some = F.col("gold") > 0
    return rows.select(
        "query_id", some.alias("eligible"), "gold", "retrieved", "hits", F.when(some, F.col("hits") / F.col("gold")).alias("session_recall"), F.when(some, F.col("hits") > 0).alias("session_hit"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), F.when(some, F.when(best > 0, F.col("dcg") / _ideal(best)).otherwise(0.0)).alias("ndcg"),
    )


def memory_effect(cold: DataFrame, warm: DataFrame, covered: DataFrame, metric: str) -> DataFrame:
    """(covered, n, cold, warm, delta): means of a metric without and with memory, apart for questions that memory covers.

    With shuffled or random memory for ``warm`` the same gives the placebo.
    """
    both = cold.select("query_id", F.col(metric).alias("x")).join(warm.select("query_id", F.col(metric).alias("y")), "query_id")
    both = both.join(covered.select("query_id", F.lit(True).alias("covered")).distinct(), "query_id", "left").withColumn("covered", F.col("covered").isNotNull())
    return both.groupBy("covered").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cold"), F.avg("y").alias("warm"), F.avg(F.col("y") - F.col("x")).alias("delta"))


def best_chunk(chunks: DataFrame, low: int = 300, high: int = 2500) -> DataFrame:
    """(doc, chunk_id, size): of each document the longest chunk of ``low`` to ``high`` characters, ties to the smaller id."""
    sized = chunks.select("doc", "chunk_id", F.length("text").alias("size")).where(F.col("size").between(low, high))
    best = sized.groupBy("doc").agg(F.min(F.struct((-F.col("size")).alias("s"), "chunk_id")).alias("b"))
    return best.select("doc", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.s")).alias("size"))


def summary(rows: DataFrame) -> DataFrame:
    """Macro means over questions."""
    names = ("precision", "recall", "f1", "rr", "ndcg")
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.avg(c).alias(c) for c in names], F.sum(F.col("solved").cast("long")).alias("solved"))


def head_to_head(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row: wins, losses and ties of a against b."""
    both = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id")
    near = F.abs(F.col("x") - F.col("y")) <= 1e-12
    return both.agg(F.count(F.when(~near & (F.col("x") > F.col("y")), 1)).alias("wins"), F.count(F.when(~near & (F.col("x") < F.col("y")), 1)).alias("losses"), F.count(F.when(near, 1)).alias("ties"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, user, assistant): a user's turn with the assistant's right after it; lone assistant turns count if not blank."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.where("role IN ('user', 'assistant')").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w), "last_role": F.lag("role").over(w)})
    user = F.col("role") == "user"
    lone = (F.col("role") == "assistant") & (F.coalesce("last_role", F.lit("")) != "user") & (F.trim("text") != "")
    kept = rows.where(user | lone).select("conv_id", "turn", F.when(user, F.col("text")).otherwise("").alias("user"), F.when(user, F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("")).otherwise(F.col("text")).alias("assistant"))
    return kept.withColumn("pair", F.row_number().over(w) - 1).select("conv_id", "pair", "user", "assistant")


def percentiles(values: DataFrame, column: str, by: str) -> DataFrame:
    """Exact, interpolated median and 95th percentile, and the mean."""
    return values.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.95).alias("p95"))
