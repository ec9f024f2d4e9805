"""Links from titles mentioned in texts, and titles mentioned in questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, with_title_aliases, with_title_match
from ..sources.scratch import kept
from .containment import contained


def unique_aliases(chunks: DataFrame) -> DataFrame:
    """(alias, width, target): names that belong to one chunk only; alias is its tokens joined by blanks."""
    rows = with_title_aliases(chunks.select(F.col("chunk_id").alias("target"), "title"), "title", "names").select("target", F.explode("names").alias("a"))
    rows = rows.select("target", F.array_join("a", " ").alias("alias"), F.size("a").alias("width"))
    return rows.groupBy("alias", "width").agg(F.min("target").alias("target"), F.max("target").alias("other")).where("target = other").drop("other")


def title_links(chunks: DataFrame) -> DataFrame:
    """(s, p, o): a chunk references every other chunk whose unambiguous name stands in its text.

    Texts and names are met as runs of tokens between blanks: each name is looked up by the rarest of its tokens.
    """
    aliases = kept(unique_aliases(chunks), "aliases")
    line = lambda t: F.concat(F.lit("| "), F.array_join(t, " "), F.lit(" |"))
    texts = kept(chunks.select("chunk_id", tokens("text").alias("t")).where(F.size("t") > 1).select(F.col("chunk_id").alias("text_id"), line("t").alias("text")), "token-lines")
    # the bars at both ends make words of the first and last token too
    names = aliases.select(F.col("alias").alias("pattern_id"), F.concat(F.lit(" "), "alias", F.lit(" ")).alias("pattern"))
    found = contained(texts, names, whole_words=True).join(aliases.select(F.col("alias").alias("pattern_id"), "target"), "pattern_id")
    return found.where("text_id <> target").select(F.col("text_id").alias("s"), F.lit("references").alias("p"), F.col("target").alias("o")).distinct()


def title_seeds(label_hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, affinity, offset, words, label_rank) of label hits whose title a question mentions."""
    asked = queries.select("query_id", "question", F.greatest(F.size(F.filter(F.split("question", "\\s+"), lambda w: w != "")), F.lit(1)).alias("words"))
    rows = with_title_match(label_hits.join(asked, "query_id"), "question", "label", "m").where("m IS NOT NULL")
    rows = rows.join(chunks.select("chunk_id"), rows["node_id"] == chunks["chunk_id"])
    return rows.select("query_id", "chunk_id", F.col("m.affinity").alias("affinity"), F.col("m.offset").alias("offset"), "words", F.col("rank").alias("label_rank"))
