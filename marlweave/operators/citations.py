"""Edges between articles that cite each other by number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A citation, perhaps of another law that is named in corner brackets before it.
CITATION = r"(?:「([^」]+)」\s*)?(제[0-9]+조(?:의[0-9]+)?)"


def citations(articles: DataFrame) -> DataFrame:
    """(s, p, o): an article references each other one that it cites; articles: doc_id, law, article_no, text.

    A number belongs to the law named before it if the corpus has that law, else to the article's own. Texts are
    expected in composed form (``hangul.nfc``). Of articles with the same law and number the last id counts.
    """
    at = F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))
    found = articles.select(F.col("doc_id").alias("s"), "law", F.explode(F.array_distinct(at)).alias("m"))
    found = found.select("s", "law", F.nullif(F.regexp_extract("m", CITATION, 1), F.lit("")).alias("scope"), F.regexp_extract("m", CITATION, 2).alias("article_no"))
    laws = articles.select(F.col("law").alias("scope"), F.lit(True).alias("known")).distinct()
    scoped = found.join(laws, "scope", "left").select("s", F.when(F.col("known"), F.col("scope")).otherwise(F.col("law")).alias("law"), "article_no")
    named = articles.groupBy("law", "article_no").agg(F.max("doc_id").alias("o"))
    return scoped.join(named, ["law", "article_no"]).where("s <> o").select("s", F.lit("references").alias("p"), "o").distinct()
