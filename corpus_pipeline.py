"""The corpus pipeline: documents through five of the training-data operators, stage by stage.

Every stage takes the whole table its predecessor kept, as written and read again, and works on
whole texts; all but the last give the columns of documents back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlweave.llm import decontam, langid, near_dedup, packing, secrets
from marlweave.llm.common import staged, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised (no letter, or far from every model).

    Null and empty texts go. Copies and repeated rows stay or go together. Models are learned from the table's own
    ``lang``; where nothing can be learned, nothing is recognised, and all go. An empty table stays empty.
    """
    (found,) = unused(docs, "language")
    return langid.identify(docs, out=found).where(F.col(found)["accepted"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of every class of near duplicates.

    Null and empty texts are copies of each other: one stays. Of repeated rows with that id one stays; a null id
    counts as largest. An empty table stays empty.
    """
    return near_dedup.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts hold none and stay; repeated rows stay or go together; with an empty benchmark all stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with the secrets in its text masked; n_chars follows the text.

    Null and empty texts stay as they are, as do repeated rows; an empty table stays empty.
    """
    (spans,) = unused(docs, "secrets")
    found = secrets.scan(docs, out=spans, redacted="text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; a null or empty text is the single id 0, repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]
#: Language models, alignments and the field are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
