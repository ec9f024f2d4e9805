"""Minimax contiguous partition of documents into shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import whole_text


def feasible(prefix: np.ndarray, shards: int, capacity: int) -> np.ndarray | None:
    """Cuts of the greedy fill under ``capacity``, or None if more than ``shards`` are needed."""
    cuts, at, last = [0], 0, len(prefix) - 1
    while at < last:
        past = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if past == at or len(cuts) > shards:
            return None
        cuts.append(past)
        at = past
    return np.array(cuts) if len(cuts) - 1 <= shards else None


def minimax(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Start of each shard (and the end) so that the largest sum of a contiguous run is smallest.

    The capacity is found by binary search; a capacity is checked by filling shards
    greedily in order, and the cuts are those of the smallest feasible one. Shards
    past the last cut are empty.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards))
    high = max(int(prefix[-1]), low)
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, shards, middle) is not None:
            high = middle
        else:
            low = middle + 1
    cuts = feasible(prefix, shards, low)
    return np.concatenate([cuts, np.full(shards + 1 - len(cuts), len(sizes), np.int64)]).astype(np.int64)


def shard(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: int = 16,
    unit_bits: int = 16,
    rows_per_run: int = 100_000,
) -> DataFrame:
    """Assigns documents to ``shards`` of near equal bytes; equal texts share a shard.

    Documents are ordered by the MD5 of their text. The atomic groups are the runs of
    texts with the same leading ``unit_bits`` bits, at most 2**unit_bits of them however
    large the input, so their sizes fit on the driver; equal texts are never in two.
    A capacity is feasible if filling shards with the groups in order needs no more
    than ``shards``; the smallest one is found by binary search.

    A group with more than ``rows_per_run`` rows (a hot text) is numbered in several
    runs, chosen by the row's id, so that no task sorts it alone.

    Result: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0
    in its shard), shard_bytes. A null text counts as empty (the empty and the null are one
    group); ids may be null or repeat, rows stay rows; an empty table gives no
    rows. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.md5("text").alias("key"),
    )
    digits = -(-unit_bits // 4)
    unit = F.shiftright(F.conv(F.substring("key", 1, digits), 16, 10).cast("long"), 4 * digits - unit_bits)
    rows = rows.withColumn("unit", unit)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("unit")
    sizes = units["size"].to_numpy(np.int64)
    count = units["n"].to_numpy(np.int64)
    cuts = minimax(sizes, shards)
    home = np.searchsorted(cuts[1:], np.arange(len(sizes)), side="right")
    before = np.concatenate([[0], np.cumsum(count)])
    first = before[:-1] - before[cuts[:-1]][np.minimum(home, shards - 1)] if len(sizes) else before[:0]
    weight = np.bincount(home, sizes, shards).astype(np.int64) if len(sizes) else np.zeros(shards, np.int64)
    runs = 1 + (count - 1) // rows_per_run
    start: dict[tuple[int, int], int] = {}
    if (runs > 1).any():
        hot = units["unit"].to_numpy()[runs > 1].tolist()
        many = dict(zip(units["unit"].tolist(), runs.tolist()))
        plan = spark.createDataFrame([(u, many[u]) for u in hot], "unit long, runs long")
        parts = (
            rows.select("unit", salt.alias("salt")).join(F.broadcast(plan), "unit").groupBy("unit", F.pmod("salt", "runs").alias("run")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["unit", "run"])
        )
        for u, own in parts.groupby("unit"):
            at = 0
            for r, n in zip(own["run"].tolist(), own["n"].tolist()):
                start[(int(u), int(r))] = at
                at += n
    schema = T.StructType.fromDDL("unit long, runs long, run long, shard int, base long, shard_bytes long")
    table = [
        (int(u), int(k), r, int(s), int(b) + start.get((int(u), r), 0), int(weight[s]))
        for u, k, s, b in zip(units["unit"].tolist(), runs.tolist(), home.tolist(), first.tolist())
        for r in range(int(k))
        if k == 1 or (int(u), r) in start
    ]
    place = spark.createDataFrame(table, schema)
    # at most 2**unit_bits rows, and one more for each rows_per_run rows of a hot text: broadcast only while that is small
    small = len(table) <= 4 << unit_bits
    wide = place.select("unit", "runs").distinct()
    rows = rows.join(F.broadcast(wide) if small else wide, "unit").withColumn("run", F.pmod(salt, F.col("runs"))).drop("runs")
    place = place.drop("runs")
    order = Window.partitionBy("unit", "run").orderBy("key", "doc_id", "size", "text_crc32")
    return (
        rows.join(F.broadcast(place) if small else place, ["unit", "run"])
        .withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "slot", "shard_bytes")
    )
