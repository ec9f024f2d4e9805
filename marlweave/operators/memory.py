"""Confirmed answers: which question led to which chunk, and a growing vault of facts and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .containment import contained


def remember(memory: DataFrame, events: DataFrame) -> DataFrame:
    """Adds (chunk_id, query, seq) events; blank questions and known pairs change nothing."""
    new = events.select("chunk_id", F.trim("query").alias("query"), "seq").where("query <> ''")
    both = memory.select("chunk_id", "query", "seq").unionByName(new)
    return both.groupBy("chunk_id", "query").agg(F.min("seq").alias("seq"))


def forget(memory: DataFrame, pairs: DataFrame) -> DataFrame:
    return memory.join(pairs.select("chunk_id", F.trim("query").alias("query")), ["chunk_id", "query"], "left_anti")


def drop_chunks(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def observe_ranked(memory: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Remembers the question for every ranked chunk that is relevant. ranked: query, chunk_id, seq; relevant: query, chunk_id."""
    return remember(memory, ranked.join(relevant.select("query", "chunk_id").distinct(), ["query", "chunk_id"], "left_semi").select("chunk_id", "query", "seq"))


def text(memory: DataFrame) -> DataFrame:
    """(chunk_id, text): a chunk's questions in order, joined by blanks."""
    w = F.array_sort(F.collect_list(F.struct("seq", "query")))
    return memory.groupBy("chunk_id").agg(F.array_join(F.transform(w, lambda x: x["query"]), " ").alias("text"))


def fuse_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """The (s, p, o, pos) facts of ``new`` that are not known yet, each once."""
    once = new.groupBy("s", "p", "o").agg(F.min("pos").alias("pos"))
    return once.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("s", "p", "o", "pos")


def auto_entities(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """(note_id, entities): known labels of two characters or more that stand in a note's text, sorted.

    Notes and labels are met by words or pairs of characters, see ``containment``.
    """
    known = labels.where(F.length("label") >= 2).select(F.col("label").alias("pattern_id"), F.col("label").alias("pattern")).distinct()
    hits = contained(notes.select(F.col("note_id").alias("text_id"), "text"), known).groupBy(F.col("text_id").alias("note_id")).agg(F.array_sort(F.collect_set("pattern_id")).alias("entities"))
    return notes.select("note_id").join(hits, "note_id", "left").select("note_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def salience(events: DataFrame) -> DataFrame:
    """(label, value): sum of what each label was given. events: label, amount."""
    return events.groupBy("label").agg(F.sum("amount").alias("value"))


def salience_events(new_facts: DataFrame, notes: DataFrame, surfaced: DataFrame) -> DataFrame:
    """1 for each end of a new fact and each entity of a note, a half for each surfaced node."""
    ends = new_facts.select(F.explode(F.array("s", "o")).alias("label"), F.lit(1.0).alias("amount"))
    own = notes.select(F.explode("entities").alias("label"), F.lit(1.0).alias("amount"))
    return ends.unionByName(own).unionByName(surfaced.select("label", F.lit(0.5).alias("amount")))


def by_salience(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, label, value, rank): evidence nodes of a question, most salient first."""
    rows = nodes.join(values, "label", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "label")))
