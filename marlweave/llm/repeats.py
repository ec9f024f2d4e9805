"""Exact repeats within and across documents: what both substring operators share.

A text is a sequence of units (bytes or words). A window of ``width`` units repeats
if the same sequence starts anywhere else. Every window has an anchor: of its runs of
``gram`` units the one with the smallest hash, the leftmost of equals. Equal windows have
equal anchors at equal distances, so a window can repeat only with windows around the
other occurrences of its anchor. That gives the distribution:

1. Each different text lists its anchors with a hash of the run, and one of the anchor's context:
   all units that windows with this anchor can cover. Anchors are counted by hash, as packs of
   numbers; an anchor that occurs once, in a text without copies, can't repeat, and goes.
2. One context of each kind is sent to its hash's group (one that is alone there is resolved where its text is), with the number of its occurrences (two where the
   text has copies), and the operator's own method (``resolve``) finds the maximal repeats inside the group.
   A group of more kinds than ``most_kinds`` is never gathered: its windows are counted over the
   cluster, by two independent hashes.
3. Spans go back to the texts by the kind of context, with a digest of the context's bytes, and are united.
   Each text compares the digests with its own bytes before anything is removed.

A text is handled once however many copies it has, and only the last join meets the copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, blocks, join_runs, mix, prefix_hash, ranges, sliding_min, span_hash, staged, symbol_table, text_key, utf8, whole_text, window_hash
from .packs import PACKS, Packer, range_bits, texts
from .packs import repeated as repeated_keys

SYMBOLS = symbol_table(17)
ODD = U64(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Unit:
    """How a text is cut into units."""

    values: Callable  # bytes, offsets of texts -> a number for each unit, offsets of texts in units
    split: Callable  # the bytes of a text -> what can be sliced by units
    join: Callable  # a slice -> bytes
    glue: bytes  # what stands between joined units
    measure: Callable  # the bytes sent for a context -> as values, of one text each


def byte_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return SYMBOLS[data], offsets


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word; words end at white space and at the end of a text."""
    gap = SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    inside = ~gap
    start = inside.copy()
    start[1:] &= gap[:-1] | first[1:-1]
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= gap[1:] | first[1:-1]
    ends = np.flatnonzero(stop) + 1
    h = prefix_hash(SYMBOLS[data])
    words = mix(span_hash(h, starts, ends - starts) + (ends - starts).astype(U64))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


BYTES = Unit(byte_values, bytes, bytes, b"", byte_values)
WORDS = Unit(word_values, bytes.split, b" ".join, b" ", word_values)


def anchors(values: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts: text, place, hash of the run, and hash of the context, of each anchor."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - width + 1, 0)
    if not counts.any():
        return none
    reach = width - gram + 1
    prefix = prefix_hash(values)
    run = window_hash(prefix, gram)
    key = ((run * ODD) & U64(0xFFFFFFFF00000000)) | np.arange(len(run), dtype=U64)
    lowest = sliding_min(key, reach)
    place = (lowest[ranges(offsets[:-1], counts)] & U64(0xFFFFFFFF)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    text = np.searchsorted(offsets, place, side="right") - 1
    left = np.maximum(offsets[text], place - (reach - 1))
    right = np.minimum(offsets[text + 1], place + width)
    context = mix(span_hash(prefix, left, right - left) + mix((place - left).astype(U64) * ODD + (right - left).astype(U64)))
    return text, place - offsets[text], mix(run[place]), context


ANCHOR = {"context": "u8", "place": "u4", "copied": "u1"}


def list_anchors(unit: Unit, width: int, gram: int, block: int, bits: int, common: int = 64):
    """Packs of the anchors of (tid, text, copied) rows, by hash of the run; a text that the task met before is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(ANCHOR, bits, "copied", common)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            tid = batch.column(0).to_pylist()
            copied = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets, block):
                own = offsets[a : b + 1]
                text, place, h, context = anchors(*unit.values(data[own[0] : own[-1]], own - own[0]), width, gram)
                some = np.unique(text)
                new = np.full(b - a, -1, np.int64)
                for i in some.tolist():
                    if pack.fresh(tid[a + i]):
                        new[i] = pack.text(tid[a + i], 0)
                keep = new[text] >= 0
                if keep.any():
                    pack.add(h[keep], new[text[keep]], context[keep], place[keep], copied[a + text[keep]])
                if pack.full():
                    yield pack.flush()
        yield pack.flush()

    return run


def send_contexts(unit: Unit, resolve: Callable, width: int, gram: int):
    """Cuts the asked contexts out of a text, once in a task; those alone in their group are resolved here, and only their marks are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            alone: list[tuple] = []
            held = 0
            for h, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if h in seen:
                    continue
                seen.add(h)
                units = unit.split((text.as_py() or "").encode())
                for x in asked.as_py():
                    left = max(0, x["place"] - (width - gram))
                    body = unit.join(units[left : x["place"] + width])
                    (alone if x["alike"] else out).append((x["h"], x["context"], x["n"], x["place"] - left, body))
                    held += len(body)
                if held > 2 << 20:
                    yield from sent_rows(unit, resolve, out, alone)
                    out, alone, held = [], [], 0
            yield from sent_rows(unit, resolve, out, alone)

    return run


def sent_rows(unit: Unit, resolve: Callable, out: list[tuple], alone: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        h, context, n, left, body = zip(*out)
        none = [None] * len(out)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(context, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.int32()), pa.array(body, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=SENT)
    if alone:
        alone.sort(key=lambda x: x[:2])
        h, context, n, left, body = zip(*alone)
        marks = marked(unit, resolve, np.array(h), np.array(context), np.array(n), np.array(left), pa.array(body, pa.binary()))
        size = marks.num_rows
        yield pa.RecordBatch.from_arrays([marks["h"], marks["context"], pa.array([None] * size, pa.int64()), pa.array([None] * size, pa.int32()), pa.array([None] * size, pa.binary()), marks["begin"], marks["end"], marks["proof"]], names=SENT)


CONTEXTS = "h long, context long, n long, left int, body binary, begin int, end int, proof binary"
SENT = [x.split()[0] for x in CONTEXTS.split(", ")]
MARKS = "h long, context long, begin int, end int, proof binary"


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


@dataclass
class Groups:
    """Contexts of whole groups, one after another; groups are numbered in order."""

    group: np.ndarray
    copies: np.ndarray  # how often each context occurs; two also stands for more
    left: np.ndarray  # units before the anchor
    data: np.ndarray  # bytes of all bodies
    body: np.ndarray  # offsets of bodies in bytes
    values: np.ndarray  # numbers of all units
    at: np.ndarray  # offsets of contexts in units


def marked(unit: Unit, resolve: Callable, h: np.ndarray, context: np.ndarray, n: np.ndarray, left: np.ndarray, bodies: pa.Array) -> pa.RecordBatch:
    """The marks of contexts sorted by h; what overlaps in a context is united."""
    data, body = utf8(bodies)
    values, at = unit.measure(data, body)
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    left = left.astype(np.int64)
    who, begin, end = resolve(Groups(group, n, left, data, body, values, at))
    # contexts are set apart by more than their length
    apart = 2 * int(np.diff(at).max(initial=0)) + 2
    begin, end = join_runs(who * apart + begin + left[who], who * apart + end + left[who])
    who = begin // apart
    begin, end = begin - who * apart - left[who], end - who * apart - left[who]
    raw = data.tobytes()
    proof = {i: digest(raw[body[i] : body[i + 1]]) for i in np.unique(who[n[who] > 1]).tolist()}
    return pa.RecordBatch.from_arrays(
        [pa.array(h[who]), pa.array(context[who]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array([proof.get(i) for i in who.tolist()], pa.binary())],
        names=["h", "context", "begin", "end", "proof"],
    )


def by_groups(unit: Unit, resolve: Callable[[Groups], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
    """Runs ``resolve`` on rows sorted by h and context, some whole groups at a time; marks that were sent pass."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        done = table["body"].is_null()
        for x in table.filter(done).select(["h", "context", "begin", "end", "proof"]).to_batches():
            yield x
        table = table.filter(pc.invert(done)).combine_chunks()
        if not table.num_rows:
            return
        h, context = table["h"].to_numpy(), table["context"].to_numpy()
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (context[1:] == context[:-1])])  # sent by two tasks
        if again.any():
            table = table.filter(pa.array(~again)).combine_chunks()
            h, context = h[~again], context[~again]
        yield marked(unit, resolve, h, context, table["n"].to_numpy(), table["left"].to_numpy(), table["body"].chunk(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            whole = int(np.searchsorted(h, h[-1], side="left"))  # the last group may go on
            if whole:
                yield from solve(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def list_windows(unit: Unit, width: int):
    """A row for each window of the contexts, for the groups of too many kinds, with two hashes of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, body = utf8(batch.column("body"))
            left = batch.column("left").to_numpy().astype(np.int64)
            proof = pa.array([digest(x.as_py()) for x in batch.column("body")], pa.binary())
            for a, b in blocks(body, 1 << 19):
                own = body[a : b + 1]
                values, at = unit.measure(data[own[0] : own[-1]], own - own[0])
                counts = np.maximum(np.diff(at) - width + 1, 0)
                start = ranges(at[:-1], counts)
                who = np.repeat(np.arange(b - a), counts)
                size = np.full(len(start), width)
                one, two = (mix(span_hash(prefix_hash(x), start, size)) for x in (values, mix(values ^ ODD)))
                place = pa.array(who + a)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(place) for c in ("h", "context", "n")), pa.array((start - at[who] - left[who + a]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), proof.take(place)],
                    names=["h", "context", "n", "begin", "w", "v", "proof"],
                )

    return run


def repeated(
    docs: DataFrame,
    unit: Unit,
    resolve: Callable,
    width: int,
    gram: int,
    most_kinds: int,
    block: int = 1 << 19,
    bucket: int = 2 << 20,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The repeated spans (tid, spans) of each text that has any; docs: doc_id, text, tid.

    A span has the marks of one context, relative to the ``place`` of its anchor, and its proof: null for the
    only text that has it.
    """
    # texts with copies: the row of the smallest id stands for them
    copied = staged(docs.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("tid", "first"), "copied")
    some = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    few = copied.limit(broadcast_rows + 1).count() <= broadcast_rows
    once = docs.join((F.broadcast(copied) if few else copied).withColumn("copied", F.lit(1)), "tid", "left").where("copied IS NULL OR doc_id <=> first")
    listed = once.select("tid", "text", F.coalesce("copied", F.lit(0)).alias("copied"))
    bits = range_bits(2 * some["bytes"] // (width - gram))
    packs = staged(listed.mapInArrow(list_anchors(unit, width, gram, block, bits), PACKS), "anchors")
    again = staged(repeated_keys(packs, ANCHOR, "copied", "context").select(F.col("key").alias("h"), "context", F.col("h").alias("d"), F.col("place").cast("int").alias("place"), F.expr("copied % 2").alias("copied"), "alike"), "repeated-anchors")
    name = texts(packs).select(F.col("h").alias("d"), "tid")

    kinds = again.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("copied"), F.min(F.struct("d", "place")).alias("at"), F.min("alike").alias("alike"))
    kinds = kinds.withColumn("n", F.col("n") + F.col("copied"))
    asked = kinds.groupBy(F.col("at.d").alias("d")).agg(F.collect_list(F.struct(F.col("at.place").alias("place"), "h", "context", "n", "alike")).alias("asked"))
    # one row of each text sends its contexts
    asked = asked.join(name, "d").join(copied, "tid", "left").withColumn("single", F.col("first").isNull())
    sent = docs.join(asked, "tid").where("single OR doc_id <=> first").select("d", "text", "asked").mapInArrow(send_contexts(unit, resolve, width, gram), CONTEXTS)

    hot = kinds.groupBy("h").count().where(F.col("count") > most_kinds).select("h")
    near = lambda rows: rows.repartition("h").sortWithinPartitions("h", "context").mapInArrow(by_groups(unit, resolve, bucket), MARKS)
    if hot.take(1):
        sent = staged(sent, "contexts")
        windows = sent.join(hot, "h", "left_semi").where("body IS NOT NULL").select("h", "context", "n", "left", "body").mapInArrow(list_windows(unit, width), "h long, context long, n long, begin int, w long, v long, proof binary")
        twice = windows.groupBy("h", "begin", "w", "v").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
        counted = windows.join(twice, ["h", "begin", "w", "v"], "left_semi").select("h", "context", "begin", (F.col("begin") + width).alias("end"), "proof").distinct()
        marks = near(sent.join(hot, "h", "left_anti")).unionByName(counted)
    else:
        marks = near(sent)
    marks = marks.groupBy("h", "context").agg(F.collect_list(F.struct("begin", "end")).alias("marks"), F.max("proof").alias("proof"))
    spans = again.join(marks, ["h", "context"]).select("d", F.struct("place", "marks", "proof").alias("span"))
    return spans.join(name, "d").groupBy("tid").agg(F.collect_list("span").alias("spans"))


def checked(unit: Unit, units, spans: pa.StructArray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of a text's marks, after its contexts were compared with their proofs."""
    place, marks = spans.field("place").to_numpy().astype(np.int64), spans.field("marks")
    for at, proof in zip(place.tolist(), spans.field("proof").to_pylist()):
        if proof is not None and digest(unit.join(units[max(0, at - (width - gram)) : at + width])) != proof:
            raise RuntimeError("two contexts have the same hashes; nothing was removed: another gram gives other hashes")
    place = np.repeat(place, np.diff(marks.offsets.to_numpy()))
    inner = marks.flatten()
    return place + inner.field("begin").to_numpy(), place + inner.field("end").to_numpy()


def cut(unit: Unit, width: int, gram: int):
    """Removes the united spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                units = unit.split((text.as_py() or "").encode())
                n = len(units)
                if not spans.is_valid or not len(spans):
                    rows.append((n, 0, [], unit.join(units)))
                    continue
                begin, end = join_runs(*checked(unit, units, spans.values, width, gram))
                kept, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    if a > at:
                        kept.append(unit.join(units[at:a]))
                    at = b
                if at < n:
                    kept.append(unit.join(units[at:]))
                out = [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                rows.append((n, int((end - begin).sum()), out, unit.glue.join(kept)))
            n, removed, spans, kept = zip(*rows) if rows else ((),) * 4
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n", "removed", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, id_column: str, text_column: str, unit: Unit, resolve: Callable, width: int, gram: int, most_kinds: int) -> DataFrame:
    """doc_id, n, removed, spans, kept of every row."""
    # both joins with the texts read the same exchange, so the condition on tid, which is never null, stands for both
    docs = df.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).withColumn("tid", text_key(F.col("text"))).where("tid IS NOT NULL")
    spans = repeated(docs, unit, resolve, width, gram, most_kinds)
    result = T.StructType([T.StructField("doc_id", df.schema[id_column].dataType), *T.StructType.fromDDL("n long, removed long, spans array<struct<begin:long,end:long>>, kept binary").fields])
    return docs.join(spans, "tid", "left").select("doc_id", "text", "spans").mapInArrow(cut(unit, width, gram), result)
