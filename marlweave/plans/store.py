"""A corpus that changes: versions of chunks, memory and index, with an overlay over the last compaction."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import lexical, memory, mutation
from ..sources import manifest
from .engine import Engine

CHUNKS = "chunk_id string, slot long, title string, text string, entities array<string>, embedding array<double>, meta string"
MEMORY = "chunk_id string, query string, seq long"
POSTINGS = "slot long, term string, tf_title long, tf_body long, tf_memory long"
LENGTHS = "slot long, len_title long, len_body long, len_memory long"
TABLES = {"chunks": CHUNKS, "memory": MEMORY, "postings": POSTINGS, "lengths": LENGTHS, "new_postings": POSTINGS, "new_lengths": LENGTHS, "touched": "slot long"}
GRAPH = {"nodes": "node_id string, label string, kind string, pos long", "edges": "pos long, s string, p string, o string"}


class Store:
    """Chunks with upserts, deletes and confirmed answers, searchable at every revision.

    The index is a base and an overlay: postings of the chunks changed since the base was written, and their slots, whose
    base postings no longer count. A change derives postings of the chunks it touches only. ``compact`` writes
    overlay and base as one. A revision is a manifest that names immutable tables: who holds a ``view`` keeps it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Opens the newest revision under ``path``."""
        found = manifest.latest(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        self.spark, self.path = spark, path
        self.revision, self.about = found
        self.closed = False

    @classmethod
    def create(cls, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, memory_pairs: DataFrame | None = None, config: Config = DEFAULT) -> Store:
        """Writes revision 0 of a corpus; slots of ``chunks`` stay as they are."""
        spark = chunks.sparkSession
        highest = chunks.agg(F.max("slot")).first()[0]
        pairs = memory_pairs if memory_pairs is not None else spark.createDataFrame([], MEMORY)
        docs = lexical.tokenized(chunks, slotted(pairs, chunks))
        tables = {"chunks": fitted(chunks, CHUNKS), "memory": fitted(pairs, MEMORY), "nodes": fitted(nodes, GRAPH["nodes"]), "edges": fitted(edges, GRAPH["edges"])}
        tables |= {"postings": fitted(lexical.postings(docs), POSTINGS), "lengths": fitted(lexical.lengths(docs), LENGTHS)}
        about = {"next_slot": 0 if highest is None else highest + 1, "config": asdict(config), "next_seq": (pairs.agg(F.max("seq")).first()[0] or 0) + 1}
        manifest.commit(spark, path, 0, about | {name: written(df, path, name) for name, df in tables.items()})
        return cls(spark, path)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Ends use of this handle; the folder and other handles stay. May be called again."""
        self.closed = True

    def table(self, name: str) -> DataFrame:
        if self.closed:
            raise ValueError("the store is closed")
        schema = {**TABLES, **GRAPH}[name]
        return self.spark.read.schema(schema).parquet(self.about[name]) if self.about.get(name) else self.spark.createDataFrame([], schema)

    def index(self) -> lexical.Index:
        """Base without touched slots, and the overlay."""
        touched = self.table("touched")
        postings = mutation.overlay(self.table("postings"), touched, self.table("new_postings"))
        lengths = mutation.overlay(self.table("lengths"), touched, self.table("new_lengths"))
        average = lambda f: F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"avg_{f}")
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), *[average(f) for f in lexical.FIELDS])
        return lexical.Index(postings, lengths, stats, lexical.term_stats(postings))

    def view(self) -> Engine:
        """An engine over this revision; later changes do not reach it."""
        engine = Engine(self.table("chunks"), self.table("nodes"), self.table("edges"), slotted(self.table("memory"), self.table("chunks")), Config(**self.about["config"]), store=self)
        engine.fielded = mutation.is_fielded(engine.chunks, bool(self.table("memory").limit(1).count()))
        engine.built["chunks"] = self.index()
        return engine

    def upsert_chunks(self, batch: DataFrame) -> dict:
        """Inserts or replaces chunks (chunk_id and any of title, text, entities, embedding, meta; ``pos`` orders new ones).

        Returns inserted, updated, unchanged, changed, revision and reindexed (0: postings hold all fields, so a first
        title needs no new index). Raises, before anything changes, if an id repeats or is empty.
        """
        mutation.validate(batch)
        chunks = self.table("chunks")
        batch = filled(batch, chunks)
        changes = mutation.compare(chunks, batch)
        count = mutation.result(changes).first().asDict()
        if count["changed"]:
            new = mutation.upsert(chunks, batch, self.about["next_slot"])
            data = written(new, self.path, "chunks")
            new = self.spark.read.schema(CHUNKS).parquet(data)
            some = changes.where("change <> 'unchanged'").select("chunk_id")
            touched = new.join(some, "chunk_id", "left_semi").select("slot")
            self._publish({"chunks": data, "next_slot": self.about["next_slot"] + count["inserted"]}, new, self.table("memory"), touched)
        return count | {"revision": self.revision, "reindexed": 0}

    def delete_chunks(self, ids: DataFrame | Iterable[str]) -> dict:
        """Removes chunks and what is remembered of them; returns deleted, missing, changed and revision."""
        ids = self._ids(ids)
        chunks = self.table("chunks")
        count = mutation.delete_result(chunks, ids).first().asDict()
        if count["deleted"]:
            touched = chunks.join(ids, "chunk_id", "left_semi").select("slot")
            memory_pairs = memory.drop_chunks(self.table("memory"), ids)
            new = mutation.delete(chunks, ids)
            self._publish({"chunks": written(new, self.path, "chunks"), "memory": written(memory_pairs, self.path, "memory")}, new, memory_pairs, touched)
        return count | {"changed": bool(count["deleted"]), "revision": self.revision}

    def remember(self, query: str, ids: DataFrame | Iterable[str]) -> int:
        """Confirms that chunks answered a question; unknown chunks are left out. Returns the revision."""
        known = self._ids(ids).join(self.table("chunks").select("chunk_id"), "chunk_id", "left_semi")
        events = known.select("chunk_id", F.lit(query).alias("query"), F.lit(self.about["next_seq"]).cast("long").alias("seq"))
        return self._memory(memory.remember(self.table("memory"), events))

    def forget(self, query: str, ids: DataFrame | Iterable[str]) -> int:
        """Takes back what was confirmed. Returns the revision."""
        return self._memory(memory.forget(self.table("memory"), self._ids(ids).withColumn("query", F.lit(query))))

    def compact(self) -> int:
        """Writes base and overlay as one; the same search results, no overlay. Returns the revision."""
        index = self.index()
        postings, lengths = written(index.postings, self.path, "postings"), written(index.lengths, self.path, "lengths")
        self._commit({"postings": postings, "lengths": lengths, "new_postings": None, "new_lengths": None, "touched": None})
        return self.revision

    def stats(self) -> dict:
        """Counts of chunks, remembered pairs, base and overlay postings and touched slots, and bytes on disk of the index."""
        names = ("chunks", "memory", "postings", "new_postings", "touched")
        fs, path = manifest.file_system(self.spark, self.path)
        size = sum(fs.getContentSummary(path(self.about[n])).getLength() for n in ("postings", "lengths", "new_postings", "new_lengths") if self.about.get(n))
        return {n: self.table(n).count() for n in names} | {"bytes": int(size), "revision": self.revision, "next_slot": self.about["next_slot"]}

    def _ids(self, ids: DataFrame | Iterable[str]) -> DataFrame:
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "chunk_id string")
        return ids.select("chunk_id").distinct()

    def _memory(self, pairs: DataFrame) -> int:
        before, columns = self.table("memory"), ["chunk_id", "query"]
        moved = pairs.select(*columns).join(before, columns, "left_anti").unionByName(before.select(*columns).join(pairs, columns, "left_anti"))
        chunks = self.table("chunks")
        touched = chunks.join(moved.select("chunk_id").distinct(), "chunk_id", "left_semi").select("slot")
        if touched.limit(1).count():
            self._publish({"memory": written(fitted(pairs, MEMORY), self.path, "memory"), "next_seq": self.about["next_seq"] + 1}, chunks, pairs, touched)
        return self.revision

    def _publish(self, new: dict, chunks: DataFrame, pairs: DataFrame, touched: DataFrame) -> None:
        """A revision in which the touched slots have the postings of ``chunks`` and ``pairs``."""
        at = written(self.table("touched").unionByName(touched).distinct(), self.path, "touched")
        touched = self.spark.read.schema("slot long").parquet(written(touched, self.path, "changed"))
        docs = lexical.tokenized(chunks.join(touched, "slot", "left_semi"), slotted(pairs, chunks).join(touched, "slot", "left_semi"))
        postings = mutation.overlay(self.table("new_postings"), touched, fitted(lexical.postings(docs), POSTINGS))
        lengths = mutation.overlay(self.table("new_lengths"), touched, fitted(lexical.lengths(docs), LENGTHS))
        self._commit(new | {"new_postings": written(postings, self.path, "postings"), "new_lengths": written(lengths, self.path, "lengths"), "touched": at})

    def _commit(self, new: dict) -> None:
        about = self.about | new
        manifest.commit(self.spark, self.path, self.revision + 1, about)
        self.revision, self.about = self.revision + 1, about


def slotted(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Remembered pairs (slot, query, seq)."""
    return pairs.join(chunks.select("chunk_id", "slot"), "chunk_id").select("slot", "query", "seq")


def fitted(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in order; missing ones are null."""
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def filled(batch: DataFrame, chunks: DataFrame) -> DataFrame:
    """A batch with all content columns, as a new chunk has them."""
    empty = {"title": F.lit(""), "text": F.lit(""), "entities": F.array().cast("array<string>"), "embedding": F.lit(None).cast("array<double>"), "meta": F.lit("{}")}
    value = lambda c: F.coalesce(F.col(c).cast(chunks.schema[c].dataType), empty[c]) if c in batch.columns else empty[c]
    return batch.select("chunk_id", *[value(c).alias(c) for c in empty], *[c for c in ("pos",) if c in batch.columns])


def written(df: DataFrame, path: str, name: str) -> str:
    at = f"{path}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return at
