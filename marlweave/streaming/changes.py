"""The log of changes as a stream: micro-batches of upserts and deletes applied to versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import mutation
from ..sources import manifest

LOG = "op_id long, op string, chunk_id string, title string, text string"
COLUMNS = "chunk_id string, slot long, title string, text string"


class ChunkStore:
    """Chunks as a chain of Parquet versions in a folder; readers keep the version they opened.

    A version counts once its manifest is there, with the revision, the next slot and the last operation. Opened again, the
    store goes on from the newest manifest, so a batch that is delivered twice changes nothing the second time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.number, self.revision, self.next_slot, self.applied, self.data = -1, 0, 0, -1, None
        found = manifest.latest(spark, path)
        if found:
            self.number, about = found
            self.revision, self.next_slot, self.applied, self.data = (about[k] for k in ("revision", "next_slot", "applied", "data"))

    @property
    def current(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(self.data) if self.data else self.spark.createDataFrame([], COLUMNS)

    def apply(self, batch: DataFrame) -> None:
        """Applies operations newer than the last one seen, in order; of several on a chunk the last counts.

        A batch that changes nothing makes no new version.
        """
        new = batch.where(F.col("op_id") > self.applied)
        latest = new.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("op_id")))).where("r = 1").drop("r").cache()
        top = latest.agg(F.max("op_id")).first()[0]
        if top is None:
            return
        put = latest.where("op = 'upsert'").select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.col("op_id").alias("pos"))
        gone = latest.where("op = 'delete'").select("chunk_id")
        changes = mutation.compare(self.current, put, ("title", "text")).groupBy("change").count().collect()
        count = {r["change"]: r["count"] for r in changes}
        revision, next_slot, data = self.revision, self.next_slot, self.data
        dropped = self.current.join(gone, "chunk_id", "left_semi").limit(1).count()
        if count.get("inserted") or count.get("updated") or dropped:
            out = mutation.delete(mutation.upsert(self.current, put, self.next_slot), gone)
            revision += 1
            data = f"{self.path}/version-{revision}-{uuid.uuid4().hex}"
            out.write.parquet(data)
            next_slot += count.get("inserted", 0)
        applied = max(self.applied, top)
        manifest.commit(self.spark, self.path, self.number + 1, {"revision": revision, "next_slot": next_slot, "applied": applied, "data": data})
        self.number, self.revision, self.next_slot, self.applied, self.data = self.number + 1, revision, next_slot, applied, data
        latest.unpersist()

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies a stream of the log until what is there now is done."""
        return log.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; on a stream, late ones are dropped after ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
