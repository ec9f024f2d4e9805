"""Keys of many texts, shuffled once in packs to find those that occur more than once.

A row for each key costs several times what the key holds. So each task numbers its texts, sorts what it
has gathered by key, and writes a row for each range of keys, packed. All packs of a range meet in
one task, which gives back only the keys that occur again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64

PACKS = "r int, base long, keys binary, body binary, tid binary, size int, extra binary"
TEXT, HOT = -1, -2
TYPES = {"i1": "tinyint", "u1": "tinyint", "u4": "long", "u8": "long"}


def range_bits(keys: int) -> int:
    """So many leading bits that a range has some four million of ``keys`` keys."""
    return max(6, min(17, (keys >> 22).bit_length()))


class Packer:
    """Gathers keys with what belongs to each (``kind``: fields and numpy types), and the texts they are of.

    Of a key that more than ``common`` entries at hand have, two go into the pack of its range and all
    others into one of their own (r = HOT): no range grows with a hot key. Those two have a bit of 2 in ``flag``.
    """

    def __init__(self, kind: dict[str, str], bits: int, flag: str | None = None, common: int = 64) -> None:
        from pyspark import TaskContext

        task = TaskContext.get()
        self.base = (task.partitionId() if task else 0) << 32
        self.kind, self.bits, self.flag, self.common = kind, bits, flag, common
        self.hold = max(1 << 18, 16 << bits)
        self.number: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.body: list[list[np.ndarray]] = []
        self.texts: list[tuple[int, bytes, int, bytes | None]] = []
        self.size = 0

    def fresh(self, tid: bytes) -> bool:
        """Whether the task has not met the text before."""
        return tid not in self.number

    def text(self, tid: bytes, size: int, extra: bytes | None = None) -> int:
        number = self.number[tid] = len(self.number)
        self.texts.append((number, tid, size, extra))
        return number

    def add(self, keys: np.ndarray, docs: np.ndarray, *body: np.ndarray) -> None:
        self.keys.append(keys)
        self.docs.append(docs.astype("<u4"))
        self.body.append([x.astype(t) for x, t in zip(body, self.kind.values())])
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= self.hold

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate([*self.keys, np.zeros(0, U64)])
        parts = [np.concatenate([*self.docs, np.zeros(0, "<u4")])] + [np.concatenate([*(b[k] for b in self.body), np.zeros(0, t)]) for k, t in enumerate(self.kind.values())]
        order = np.argsort(keys, kind="stable")
        keys, parts = keys[order], [x[order] for x in parts]
        first = np.searchsorted(keys, keys, side="left")
        many = np.searchsorted(keys, keys, side="right") - first
        hot = (many > self.common) & (np.arange(len(keys)) - first >= 2)
        if self.flag:
            parts[1 + list(self.kind).index(self.flag)] |= ((many > self.common) * 2).astype(np.uint8)
        body = lambda at: b"".join(x[at].tobytes() for x in parts)
        rows = [(HOT, keys[hot].tobytes(), body(hot))] if hot.any() else []
        keys, parts = keys[~hot], [x[~hot] for x in parts]
        r = (keys >> U64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(r, prepend=-1, append=-1))
        rows += [(int(r[x]), keys[x:y].tobytes(), body(slice(x, y))) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        none = [None] * len(rows)
        texts = self.texts
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in rows] + [TEXT] * len(texts), pa.int32()),
                pa.array([self.base] * len(rows) + [self.base + t[0] for t in texts], pa.int64()),
                pa.array([x[1] for x in rows] + [None] * len(texts), pa.binary()),
                pa.array([x[2] for x in rows] + [None] * len(texts), pa.binary()),
                pa.array(none + [t[1] for t in texts], pa.binary()),
                pa.array(none + [t[2] for t in texts], pa.int32()),
                pa.array(none + [t[3] for t in texts], pa.binary()),
            ],
            names=[x.split()[0] for x in PACKS.split(", ")],
        )
        self.keys, self.docs, self.body, self.texts, self.size = [], [], [], [], 0
        return out


def _read(kind: dict[str, str], base: int, keys: bytes, body: bytes) -> list[np.ndarray]:
    k = np.frombuffer(keys, U64)
    out, at = [k, np.frombuffer(body, "<u4", len(k)).astype(np.int64) + base], 4 * len(k)
    for t in kind.values():
        x = np.frombuffer(body, t, len(k), at)
        at += x.nbytes
        out.append(x)
    return out


def _rows(kind: dict[str, str], parts: list[np.ndarray]) -> pa.RecordBatch:
    wide = [x.astype(np.int64) if t == "u4" else x.view(np.int64) if t == "u8" else x.astype(np.int8) for x, t in zip(parts[2:], kind.values())]
    return pa.RecordBatch.from_arrays([pa.array(parts[0].view(np.int64)), pa.array(parts[1]), *map(pa.array, wide)], names=["key", "h", *kind])


def _alike(k: np.ndarray, x: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether all entries of a key (sorted) have the same x, and none is of a hot key."""
    new = np.diff(k, prepend=~k[:1]) != 0
    group = np.cumsum(new) - 1
    other = (x != x[np.flatnonzero(new)][group]) | ((flags & 2) > 0)
    return np.bincount(group, other)[group] == 0


def _repeated(kind: dict[str, str], flag: str | None, alike: str | None):
    """Packs sorted by range -> the entries of keys that a range has more than once, or whose entry is flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(parts[0], kind="stable")
            k = parts[0][order]
            same = k[1:] == k[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            at = {c: 2 + i for i, c in enumerate(kind)}
            if flag:
                keep |= parts[at[flag]][order] > 0
            parts = [x[order[keep]] for x in parts]
            out = _rows(kind, parts)
            return out.append_column("alike", pa.array(_alike(parts[0], parts[at[alike]], parts[at[flag]]))) if alike else out

        for batch in batches:
            for r, base, keys, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if r != now and held:
                    yield solve()
                    held = []
                now = r
                held.append(_read(kind, base, keys.as_py(), body.as_py()))
        if held:
            yield solve()

    return run


def _unpacked(kind: dict[str, str], alike: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, keys, body in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                out = _rows(kind, _read(kind, base, keys.as_py(), body.as_py()))
                yield out.append_column("alike", pa.array(np.zeros(out.num_rows, bool))) if alike else out

    return run


def texts(packs: DataFrame) -> DataFrame:
    """(h, tid, size, extra) of every text; one that several tasks met has a number of each."""
    return packs.where(F.col("r") == TEXT).select(F.col("base").alias("h"), "tid", "size", "extra")


def repeated(packs: DataFrame, kind: dict[str, str], flag: str | None = None, alike: str | None = None) -> DataFrame:
    """(key, h, and the fields of ``kind``) of the keys that occur more than once, or are flagged.

    With ``alike`` there is a column of that name: whether all entries of the key surely have the same value
    of that field (never said of hot keys).
    """
    schema = ", ".join(["key long", "h long", *(f"{c} {TYPES[t]}" for c, t in kind.items()), *(["alike boolean"] if alike else [])])
    rows = packs.select("r", "base", "keys", "body")
    cold = rows.where(F.col("r") >= 0).repartition("r").sortWithinPartitions("r").mapInArrow(_repeated(kind, flag, alike), schema)
    return cold.unionByName(rows.where(F.col("r") == HOT).mapInArrow(_unpacked(kind, alike), schema))
