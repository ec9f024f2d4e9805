"""A vault: facts and notes that grow, and names whose salience grows with use."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import memory
from ..sources import manifest, readers
from .build import from_edges
from .store import fitted, written

TABLES = {"facts": "pos long, s string, p string, o string", "notes": "pos long, note_id string, text string, entities array<string>", "salience": "label string, value double"}


class Vault:
    """Tables of facts, notes and salience. ``fuse`` adds batches, ``surface`` searches and reinforces what it shows.

    With a path, every change is a revision there, and an existing vault is opened.
    """

    def __init__(self, spark: SparkSession, path: str, auto_link: bool = True, reinforce: float = 0.5, config: Config = DEFAULT) -> None:
        self.spark, self.path, self.auto_link, self.reinforce, self.config = spark, path, auto_link, reinforce, config
        self.revision, self.about = manifest.latest(spark, path) or (-1, {"facts_made": 0, "notes_made": 0})
        self.engine = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self.about[name]) if self.about.get(name) else self.spark.createDataFrame([], TABLES[name])

    def fuse(self, facts: Iterable[Any] = (), notes: Iterable[tuple] = ()) -> Vault:
        """Adds facts (s, p, o), each once, and then notes (text[, entities[, id]]).

        A note without entities gets the known names that stand in it; one without an id the next number.
        """
        made, at = list(facts), self.about["facts_made"]
        rows = self.spark.createDataFrame([(at + i, *readers.edge(f)) for i, f in enumerate(made)], TABLES["facts"])
        known = self.table("facts")
        fresh = fitted(memory.fuse_facts(known, rows), TABLES["facts"])
        known = self.spark.read.schema(TABLES["facts"]).parquet(written(known.unionByName(fresh), self.path, "facts"))
        given = [(*n, None, None)[:3] if isinstance(n, tuple) else (n, None, None) for n in notes]
        first = self.about["notes_made"]
        added = self.spark.createDataFrame([(first + i, name or f"n{first + i}", text, None if own is None else list(own)) for i, (text, own, name) in enumerate(given)], TABLES["notes"])
        if self.auto_link:
            labels = known.select(F.explode(F.array("s", "o")).alias("label"))
            found = memory.auto_entities(added.where("entities IS NULL").select(F.col("pos").alias("note_id"), "text"), labels)
            added = added.join(found.select(F.col("note_id").alias("pos"), F.col("entities").alias("found")), "pos", "left").select("pos", "note_id", "text", F.coalesce("entities", "found").alias("entities"))
        added = added.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
        added = self.spark.read.schema(TABLES["notes"]).parquet(written(added, self.path, "new-notes"))
        new = known.where(F.col("pos") >= at)
        events = memory.salience_events(new, added, self.spark.createDataFrame([], "label string"))
        self._commit(events, {"facts": known, "notes": self.table("notes").unionByName(added)}, {"facts_made": at + len(made), "notes_made": first + len(given)})
        self.engine = None
        return self

    def surface(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """``Engine.search`` with evidence nodes by falling salience, at most ``limit``; those shown gain ``reinforce``.

        The engine is built again only after a change. The questions of a batch see the salience before it.
        """
        if self.engine is None:
            chunks = self.table("notes").select(F.col("note_id").alias("chunk_id"), F.col("pos").alias("slot"), F.lit("").alias("title"), "text", "entities", F.lit(None).cast("array<double>").alias("embedding"), F.lit("{}").alias("meta"))
            self.engine = from_edges(self.table("facts"), chunks, config=self.config)
        found = self.engine.search(queries)
        at = written(found, self.path, "found")
        found = self.spark.read.schema(found.schema).parquet(at)
        shown = memory.by_salience(found.select("query_id", F.explode("evidence_nodes").alias("label")), self.table("salience"))
        shown = shown.where(F.col("rank") <= limit) if limit is not None else shown
        shown = self.spark.read.parquet(written(shown.select("query_id", "label", "rank"), self.path, "shown"))
        self._commit(shown.select("label", F.lit(float(self.reinforce)).alias("amount")), {}, {})
        lists = shown.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("nodes"))
        return found.join(lists, "query_id", "left").withColumn("evidence_nodes", F.coalesce("nodes", F.array().cast("array<string>"))).drop("nodes")

    def salience(self) -> DataFrame:
        """(label, value)."""
        return self.table("salience")

    def stats(self) -> dict:
        """Counts of facts, notes and different names in facts."""
        facts = self.table("facts")
        return {"facts": facts.count(), "notes": self.table("notes").count(), "entities": facts.select(F.explode(F.array("s", "o")).alias("x")).distinct().count()}

    def _commit(self, events: DataFrame, tables: dict[str, DataFrame], counts: dict) -> None:
        values = memory.salience(self.table("salience").select("label", F.col("value").alias("amount")).unionByName(events))
        tables = tables | {"salience": values}
        about = self.about | counts | {name: written(fitted(df, TABLES[name]), self.path, name) for name, df in tables.items()}
        manifest.commit(self.spark, self.path, self.revision + 1, about)
        self.revision, self.about = self.revision + 1, about
