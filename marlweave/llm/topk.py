"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BLOCK = "block long, dim int, ids binary, vectors binary"
#: Sums below this are exact in doubles.
EXACT = 2.0**53


def packed(size: int):
    """Packs rows (id, integer vector) into blocks of at most ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([x[0] for x in held[dim]])
            vectors = np.concatenate([x[1] for x in held[dim]])
            del held[dim]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                rows = flat[starts[at][:, None] + np.arange(dim)]
                for k in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[at[k : k + size]], rows[k : k + size]))
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def read(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    who = np.frombuffer(ids, np.int64)
    return who, np.frombuffer(vectors, np.int64).reshape(len(who), dim)


def partial_scores(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """One matrix of scores for each slice of the dimensions, exact integers."""
    cuts = np.linspace(0, q.shape[1], min(lists, max(1, q.shape[1])) + 1).astype(int)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if bound < EXACT else np.int64
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:])]


def best(score: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of one row, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((who[at], -score[at]))][:k]


def gather(k: int, lists: int):
    """Phase one: from each list of a block its k highest entries, with what they sum to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, q = read(row["q_ids"], row["q_vectors"], row["dim"])
                ci, c = read(row["ids"], row["vectors"], row["dim"])
                parts = partial_scores(q, c, lists)
                seen = np.concatenate([np.argpartition(p, max(0, p.shape[1] - k - 1), axis=1)[:, max(0, p.shape[1] - k - 1) :] for p in parts], axis=1)
                keys, values = [], []
                for r in range(len(qi)):
                    at = np.unique(seen[r])
                    at = at[ci[at] != qi[r]]
                    whole = sum(p[r, at] for p in parts)
                    top = best(whole, ci[at], k)
                    keys.append(np.full(len(top), qi[r]))
                    values.append(whole[top].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], names=["query_id", "score"])

    return run


def collect(k: int, lists: int):
    """Phases two and three: entries that a list lifts to its share of the cutoff, scored in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, q = read(row["q_ids"], row["q_vectors"], row["dim"])
                ci, c = read(row["ids"], row["vectors"], row["dim"])
                low = dict(zip(row["cut_ids"], row["cuts"]))
                parts = partial_scores(q, c, lists)
                cut = np.array([low.get(x, -np.inf) for x in qi.tolist()])
                # the sum reaches the cutoff only if some list reaches its share
                near = np.zeros(parts[0].shape, bool)
                for p in parts:
                    near |= p >= np.floor(cut / len(parts))[:, None]
                keys, others, values = [], [], []
                for r in range(len(qi)):
                    at = np.flatnonzero(near[r])
                    at = at[ci[at] != qi[r]]
                    score = sum(p[r, at] for p in parts) if len(at) else np.zeros(0)
                    keep = score >= cut[r]
                    at, score = at[keep], score[keep]
                    top = best(score, ci[at], k)
                    keys.append(np.full(len(top), qi[r]))
                    others.append(ci[at[top]])
                    values.append(score[top].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(others)), pa.array(np.concatenate(values))], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    df: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    scale: float = 1024.0,
    lists: int = 4,
    query_block: int = 1024,
    row_block: int = 8192,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """The k rows with the highest integer inner product for each query row, exactly.

    A component x counts as floor(scale * x). The dimensions are cut into ``lists``
    slices, so that a score is a sum of one partial score from each list. Phase one
    takes, from every block of rows, each list's k highest entries; the k-th best sum
    among them is a lower bound of a query's k-th score, the safe cutoff. It goes back to
    all blocks. Phase two keeps an entry if any list gives it at least the cutoff's
    uniform share (if no list does, the sum is below the cutoff). Phase three sums
    what is left exactly, drops what misses the cutoff, and ranks.

    Queries meet the rows as blocks of vectors. The blocks of queries are broadcast, about ``broadcast_bytes`` at a
    time (their size is counted first): beyond that they come in parts, and the rows are read for each.

    Result: query_id, rank from 1, vec_id, score; ties go to the smaller id. Vectors that are
    null or hold null, NaN or infinite components take no part, nor do null ids;
    vectors are compared with those of their own length. A row is not its own
    candidate (nor is another row with its id). Rows that repeat an id are candidates each.
    With fewer than k candidates all are returned; none for an empty table.
    """
    x = F.col(vector_column)
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(x.isNotNull() & F.col(id_column).isNotNull()).where(finite)
    vector = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    flat = lambda d: d.select(F.col(id_column).cast("long").alias("id"), vector.alias("v"))
    asked = rows.where(is_query)
    queries = flat(asked).mapInArrow(packed(query_block), BLOCK)
    queries = queries.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    others = flat(rows).mapInArrow(packed(row_block), BLOCK)
    held = asked.agg(F.coalesce(F.sum(F.size(x) * 8 + 32), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, min(-(-held["bytes"] // max(1, broadcast_bytes)), -(-held["n"] // query_block)))
    if parts > 1:  # both are read once for each part
        queries, others = staged(queries, "queries"), staged(others, "rows")

    def meet(q: DataFrame) -> DataFrame:
        own = [q if parts == 1 else q.where(F.pmod(F.xxhash64("q_block"), F.lit(parts)) == c) for c in range(parts)]
        return reduce(DataFrame.unionByName, [others.join(F.broadcast(x), "dim") for x in own])

    pairs = meet(queries)
    lows = pairs.select("dim", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(gather(k, lists), "query_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoff = lows.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", "score")
    known = (
        queries.mapInArrow(block_ids, "q_block long, query_id long")
        .join(cutoff, "query_id")
        .groupBy("q_block")
        .agg(F.collect_list("query_id").alias("cut_ids"), F.collect_list("score").alias("cuts"))
    )
    second = meet(queries.join(known, "q_block", "left"))
    second = second.withColumns({"cut_ids": F.coalesce("cut_ids", F.array().cast("array<long>")), "cuts": F.coalesce("cuts", F.array().cast("array<long>"))})
    found = second.select("dim", "q_ids", "q_vectors", "ids", "vectors", "cut_ids", "cuts").mapInArrow(collect(k, lists), "query_id long, vec_id long, score long")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids in each block of queries."""
    for batch in batches:
        for row in batch.select(["q_block", "q_ids"]).to_pylist():
            ids = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["q_block"])), pa.array(ids)], names=["q_block", "query_id"])
