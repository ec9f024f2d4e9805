"""Upserts and deletes of chunks as new versions of tables, and index overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import bounded
from .numbering import numbered

#: Slots, of eight bytes each, are broadcast up to so many, so that postings are not shuffled to drop some.
SLOTS = 2_000_000
CONTENT = ("title", "text", "entities", "embedding", "meta")


def validate(batch: DataFrame, columns: tuple[str, ...] = CONTENT) -> None:
    """Raises ValueError, before anything changes, if a batch repeats an id or has an empty one."""
    bad = batch.agg(F.count(F.when(F.col("chunk_id").isNull() | (F.col("chunk_id") == ""), 1)).alias("empty"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("twice")).first()
    if bad["empty"] or bad["twice"]:
        raise ValueError("chunk ids of a batch must be unique and not empty")


def compare(chunks: DataFrame, batch: DataFrame, columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """(chunk_id, change): inserted, updated or unchanged, for each row of a batch."""
    columns = tuple(c for c in columns if c in batch.columns and c in chunks.columns)
    old = chunks.select("chunk_id", F.struct(*columns).alias("old"))
    rows = batch.select("chunk_id", F.struct(*columns).alias("new")).join(old, "chunk_id", "left")
    return rows.select("chunk_id", F.when(F.col("old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated").alias("change"))


def upsert(chunks: DataFrame, batch: DataFrame, next_slot: int) -> DataFrame:
    """The next version of ``chunks``: updates keep their slot, new ids get the next ones in id order.

    Slots are never used twice; ``next_slot`` is the high-water mark of the table's manifest.
    """
    known = chunks.select("chunk_id", F.col("slot"))
    order = ["pos", "chunk_id"] if "pos" in batch.columns else ["chunk_id"]
    fresh = batch.join(known, "chunk_id", "left_anti").select(*order)
    slots = known.join(batch.select("chunk_id"), "chunk_id", "left_semi").unionByName(numbered(fresh, order, "slot", next_slot).select("chunk_id", "slot"))
    columns = [c for c in chunks.columns if c not in ("chunk_id", "slot")]
    new = batch.join(slots, "chunk_id").select("chunk_id", "slot", *columns)
    return chunks.join(batch.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "slot", *columns).unionByName(new)


def delete(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def delete_result(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: deleted, missing."""
    rows = ids.select("chunk_id").join(chunks.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "left")
    return rows.agg(F.count("known").alias("deleted"), (F.count(F.lit(1)) - F.count("known")).alias("missing"))


def result(changes: DataFrame) -> DataFrame:
    """One row of counts of a batch, and whether it changes anything."""
    count = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(kind)
    return changes.agg(count("inserted"), count("updated"), count("unchanged")).withColumn("changed", (F.col("inserted") + F.col("updated")) > 0)


def overlay(base: DataFrame, overridden: DataFrame, delta: DataFrame) -> DataFrame:
    """Postings of a base table without overridden slots, and those of the delta."""
    return base.join(bounded(overridden.select("slot").distinct(), SLOTS), "slot", "left_anti").unionByName(delta)


def term_deltas(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(term, df, dfe): signed changes of frequencies between two sets of postings."""
    signed = lambda rows, sign: rows.select("term", (sign * ((F.col("tf_title") + F.col("tf_body")) > 0).cast("long")).alias("df"), (sign * (F.col("tf_memory") > 0).cast("long")).alias("dfe"))
    return signed(removed, -1).unionByName(signed(added, 1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dfe").alias("dfe"))


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Frequencies after changes; terms that no chunk has any more go."""
    return stats.unionByName(deltas).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dfe").alias("dfe")).where("df > 0 OR dfe > 0")


def is_fielded(chunks: DataFrame, memory: bool = False) -> bool:
    """Whether ranking is by fields: memory is kept, or some chunk has a title."""
    return memory or bool(chunks.where(F.length(F.coalesce("title", F.lit(""))) > 0).limit(1).count())


def modes(chunks: DataFrame) -> DataFrame:
    """One row of counters: chunks, titled, lexical, embedded, and the modes they imply."""
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    embedded = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    rows = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(filled("title")).alias("titled"), F.count_if(filled("title") | filled("text")).alias("lexical"), F.count_if(embedded).alias("embedded"))
    return rows.withColumns({"dense_mode": (F.col("chunks") > 0) & (F.col("embedded") == F.col("chunks")), "fielded_mode": F.col("titled") > 0})


def hash_groups(rows: DataFrame, seed: str, sizes: dict[str, int], key: str = "chunk_id") -> DataFrame:
    """(key, group): disjoint groups of the given sizes in order of a seeded SHA-256."""
    hashed = rows.select(key, F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")), 256).alias("h"))
    first = numbered(hashed.orderBy("h", key).limit(sum(sizes.values())), ["h", key], "r", 1)
    group, at = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        group = F.when((F.col("r") > at) & (F.col("r") <= at + n), name).otherwise(group)
        at += n
    return first.withColumn("group", group).where("group IS NOT NULL").select(key, "group")
