"""Shared helpers of the training-data operators.

Texts reach Python as Arrow batches. The helpers here view a whole column of
texts as one byte buffer with offsets, so the operators work on arrays that span
many documents instead of looping over characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the polynomial hashes; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    It is read from ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) is a folder made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='marlweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    A lost executor then costs no recomputation of what came before, and several
    consumers read it without running its plan again.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of the table's columns has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(column: str | Column) -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(column: Column) -> Column:
    """16 bytes of SHA-256 that stand for a text: equal texts have equal keys."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary array; null is empty."""
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    out = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [first, past) of rows that hold at most ``most`` bytes; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        past = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        past = min(max(past, first + 1), rows)
        yield first, past
        first = past


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def symbol_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(seed))


class Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] the sum of values[t] * BASE**t over t < i, modulo 2**64."""
    POWERS.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * POWERS.up[: len(values)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` values, wherever it starts."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U64)
    return (prefix[width:] - prefix[:n]) * POWERS.down[:n]


def span_hash(prefix: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of each span; equal content has equal hashes, wherever it stands."""
    return (prefix[start + length] - prefix[start]) * POWERS.down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenates arange(start, start + count) over all rows."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def join_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites overlapping or touching half-open intervals into maximal ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]
