"""Gapless numbers in a given order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: start, start + 1, ... in the order of the columns ``order``, ties as they come.

    Rows are split by ranges of the order; each range is numbered for itself, after the counts of those before it.
    """
    rows = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # a row for each partition
    first, at = [], start
    for part in sorted(counts):
        first += [F.lit(part), F.lit(at).cast("long")]
        at += counts[part]
    w = Window.partitionBy("__part").orderBy(*order)
    base = F.create_map(*first)[F.col("__part")] if first else F.lit(start).cast("long")
    return rows.withColumn(name, base + F.row_number().over(w) - 1).drop("__part")
