"""Benchmark decontamination by q-gram counts in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, blocks, mix, prefix_hash, ranges, text_key, unused, utf8, whole_text, window_hash

GAP = 32
FAR = 1 << 28
FILTER_BITS = 21


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower case of each letter or digit of the basic plane; GAP for all else."""
    out = np.full(1 << 16, GAP, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits in lower case with single gaps between words.

    Returns the symbols, the offsets of the texts among them, and each symbol's code point in its text.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    table = fold_table()
    folded = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)
    gap = folded == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    first = at[:-1][at[:-1] < len(keep)]
    keep[first] = ~gap[first]
    held = np.concatenate([[0], np.cumsum(keep)])[at]
    place = np.flatnonzero(keep)
    text = np.repeat(np.arange(len(at) - 1), np.diff(held))
    return folded[keep], held, place - at[text]


def budget(n: int, q: int, rate: float) -> int:
    """Edits allowed in a passage of n symbols: a share of it, as long as the lemma leaves q shared q-grams."""
    edits = int(n * rate)
    while edits and n - q + 1 - q * edits < q:
        edits -= 1
    return edits


@dataclass
class Items:
    """Passages of one chunk of the benchmark, and their q-grams in order of hash."""

    who: list[int | None]
    text: np.ndarray  # symbols of all passages
    at: np.ndarray
    edits: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def hashes(s: np.ndarray, q: int) -> np.ndarray:
    return mix(window_hash(prefix_hash(mix(s.astype(U64) + U64(1))), q))


def index(ids: list[int | None], texts: list[str], q: int, rate: float) -> Items | None:
    """None if no passage is as long as a q-gram."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    if not len(data):
        return None
    s, at, _ = symbols(data, offsets)
    size = np.diff(at)
    many = np.maximum(size - q + 1, 0)
    if not many.any():
        return None
    start = ranges(at[:-1], many)
    h = hashes(s, q)[start]
    order = np.argsort(h, kind="stable")
    item = np.repeat(np.arange(len(ids)), many)
    few = np.zeros(1 << FILTER_BITS, bool)
    few[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Items(list(ids), s, at, np.array([budget(int(n), q, rate) for n in size]), h[order], item[order], (start - at[item])[order], few)


def align(item: np.ndarray, doc: np.ndarray, low: int, edits: int) -> tuple[int, int, int] | None:
    """The best place of a passage in a text, whole passage against any part near diagonal ``low``.

    Row i of the table holds columns low - edits + i and on, over the band and ``edits`` more on
    both sides; beginning and end in the text are free. Returns (edits, begin, end), or None.
    """
    width = 2 * (edits + 1) + 2 * edits + 1
    base = low - edits
    dist = np.zeros(width, np.int64)
    start = base + np.arange(width)
    dist[(start < 0) | (start > len(doc))] = FAR
    steps = np.arange(width)
    padded = np.full(width + len(item) + 1, 0, np.uint32)
    a, b = max(0, base), min(len(doc), base + len(padded))
    if b > a:
        padded[a - base : b - base] = doc[a:b]
    for i in range(len(item)):
        col = base + i + 1 + steps  # columns after this row
        ok = (col >= 1) & (col <= len(doc))
        new = np.where(ok, dist + (padded[i : i + width] != item[i]), FAR)
        frm = start
        down = np.append(dist[1:] + 1, FAR)
        better = down < new
        new, frm = np.where(better, down, new), np.where(better, np.append(start[1:], 0), frm)
        key = new - steps
        run = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == run, steps, 0))
        new, frm = run + steps, frm[source]
        new[(col < 0) | (col > len(doc))] = FAR
        dist, start = new, frm
    k = int(dist.argmin())
    if dist[k] > edits:
        return None
    return int(dist[k]), int(start[k]), int(base + len(item) + k)


def regions(items: Items, s: np.ndarray, at: np.ndarray, q: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and lowest diagonal of the bands with enough shared q-grams.

    With e edits in a passage of n symbols at least n - q + 1 - q e of its q-grams are left, on
    diagonals at most e apart. Bands of 2 (e + 1) diagonals begin at every (e + 1)-th,
    so one of them holds all of these.
    """
    none = (np.zeros(0, np.int64),) * 3
    h = hashes(s, q)
    near = np.flatnonzero(items.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
    text = np.searchsorted(at, near, side="right") - 1
    inside = near + q <= at[text + 1]
    near, text = near[inside], text[inside]
    lo, hi = np.searchsorted(items.hashes, h[near], side="left"), np.searchsorted(items.hashes, h[near], side="right")
    some = hi > lo
    near, text, lo, many = near[some], text[some], lo[some], (hi - lo)[some]
    if not len(near):
        return none
    # a q-gram that passages repeat meets many places: they are counted some text symbols at a time
    done, keys, counts = np.cumsum(many), [], []
    a = 0
    while a < len(near):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + most, side="right")))
        key, count = _counted(items, at, near[a:b], text[a:b], lo[a:b], many[a:b])
        keys.append(key)
        counts.append(count)
        if len(keys) > 16:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts = [key], [np.bincount(back, np.concatenate(counts)).astype(np.int64)]
        a = b
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts))
    band = (key & ((1 << 26) - 1)) - (1 << 25)
    item = (key >> 26) & ((1 << 18) - 1)
    good = count >= np.diff(items.at)[item] - q + 1 - q * items.edits[item]
    return (key >> 44)[good], item[good], (band * (items.edits[item] + 1))[good]


def _counted(items: Items, at: np.ndarray, near: np.ndarray, text: np.ndarray, lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of text, item and band, and how many text symbols begin a shared q-gram there; each counts once."""
    hit = ranges(lo, many)
    text, place = np.repeat(text, many), np.repeat(near, many)
    item = items.item[hit]
    diagonal = place - at[text] - items.place[hit]
    band = diagonal // (items.edits[item] + 1)
    key = np.concatenate([_key(text, item, band), _key(text, item, band - 1)])
    spot = np.concatenate([place, place])
    order = np.lexsort((spot, key))
    key, spot = key[order], spot[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])])
    return np.unique(key[fresh], return_counts=True)


def _key(text: np.ndarray, item: np.ndarray, band: np.ndarray) -> np.ndarray:
    return (text << 44) | (item << 26) | (band + (1 << 25))


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    passage_column: str = "text",
    q: int = 10,
    rate: float = 0.06,
    chunk_items: int = 20_000,
    chunk_symbols: int = 8_000_000,
) -> DataFrame:
    """A row for each place where a whole benchmark passage stands in a text, up to the edit budget.

    Texts and passages are compared as letters and digits in lower case, with single gaps for all
    else; a passage of n symbols may have ``rate`` * n edits (fewer where the q-gram lemma would leave
    too little to count). Texts are whole. Result: doc_id, item_id, begin, end (code points in the
    text), edits; of places that overlap only the one with the fewest edits.

    The benchmark is indexed in chunks of at most ``chunk_items`` passages, and of about
    ``chunk_symbols`` characters; each is sent to all tasks, and the texts are read once for
    each. Null or empty passages, and those shorter than ``q`` symbols, never match, nor
    do null and empty texts. Repeated rows give rows each, repeated passages count once for an id, which may be null;
    empty tables give no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("i"), whole_text(passage_column).alias("t")).where("length(t) > 0").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("s")).first()
    chunks = max(1, -(-2 * size["n"] // chunk_items), -(-2 * size["s"] // chunk_symbols)) if max(size["n"] / chunk_items, size["s"] / chunk_symbols) > 1 else 1
    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("item_id long, begin long, end long, edits long").fields])
    texts = df.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    out = spark.createDataFrame([], schema)
    for c in range(chunks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == c).orderBy("i", "t").collect() if size["n"] else []
        if own and (built := index([r["i"] for r in own], [r["t"] for r in own], q, rate)):
            found = texts.mapInArrow(search(spark.sparkContext.broadcast(built), q), schema)
            out = found if c == 0 else out.unionByName(found)
    return out


def search(shared, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows: list[tuple] = []
            for a, b in blocks(offsets, 1 << 19):
                own = offsets[a : b + 1]
                if own[-1] == own[0]:
                    continue
                s, at, place = symbols(data[own[0] : own[-1]], own - own[0])
                best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for text, item, low in zip(*(x.tolist() for x in regions(items, s, at, q))):
                    doc = s[at[text] : at[text + 1]]
                    got = align(items.text[items.at[item] : items.at[item + 1]], doc, low, int(items.edits[item]))
                    if got:
                        best.setdefault((text, item), []).append(got)
                for (text, item), places in best.items():
                    kept: list[tuple[int, int, int]] = []
                    for e, x, y in sorted(places):
                        if all(y <= x2 or x >= y2 for _, x2, y2 in kept):
                            kept.append((e, x, y))
                    spot = place[at[text] : at[text + 1]]
                    rows += [(a + text, items.who[item], int(spot[x]), int(spot[y - 1]) + 1, e) for e, x, y in kept if y > x]
            i, item, begin, end, edits = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i, pa.int64())), pa.array(item, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64())],
                names=["doc_id", "item_id", "begin", "end", "edits"],
            )

    return run


def clean(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", passage_column: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` whose texts hold no benchmark passage, with all their columns, whatever their names.

    Null and empty texts stay, as does everything where the benchmark is empty; rows that repeat stay or go together.
    """
    mark, leak = unused(df, "key", "leak")
    named = df.withColumn(mark, text_key(whole_text(text_column)))
    leaks = find_leaks(named.select(mark, text_column), benchmark, mark, text_column, item_column, passage_column, **settings)
    return named.join(leaks.select(F.col("doc_id").alias(leak)).distinct(), F.col(mark) == F.col(leak), "left_anti").drop(mark)
