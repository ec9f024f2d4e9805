"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function text -> ids for a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is loaded into ``tiktoken``, whose ids are the same and
    which takes a third of the time. Files that it can't express (another
    model, an unknown split, added tokens that reach into what is around them) are run by
    ``tokenizers`` itself. The string of an added token in a text is that token's id.
    """
    said = json.loads(Path(path).read_text("utf-8"))
    pre = said.get("pre_tokenizer") or {}
    added = said.get("added_tokens", [])
    plain = (
        (said.get("model") or {}).get("type") in ("BPE", None)
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and not said.get("normalizer")
        and not said["model"].get("ignore_merges")
        and not any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if plain:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(letter[c] for c in token): at for token, at in said["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if any(x in text for x in special):
                return fast.encode(text, allowed_special="all")
            return fast.encode_ordinary(text)

        return encode
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Packs pieces of fewer than ``capacity`` tokens; returns per sequence (piece, start in it, length).

    There are as many sequences as the tokens fill. Pieces, costliest first, go to
    the sequence of the lowest cost (linear in its tokens, quadratic in
    each piece) that still has room for the whole piece; what fits nowhere whole is cut
    over the room that is left, cheapest sequence first.
    """
    total = int(lengths.sum())
    many = -(-total // capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(many)]
    if not many:
        return out
    room = [capacity] * many
    price = [0.0] * many
    cost = lambda n: linear * n + quadratic * float(n) * n
    heap = [(0.0, s) for s in range(many)]
    late = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, aside, put = int(lengths[i]), [], False
        while heap:
            top = heapq.heappop(heap)
            if room[top[1]] >= n:
                s = top[1]
                out[s].append((i, 0, n))
                room[s] -= n
                price[s] += cost(n)
                if room[s]:
                    heapq.heappush(heap, (price[s], s))
                put = True
                break
            aside.append(top)
            if len(aside) >= 64:  # the cheapest are all too full: look at the rest at once
                rest = [x for x in heap if room[x[1]] >= n]
                if not rest:
                    break
                s = min(rest)[1]
                out[s].append((i, 0, n))
                room[s] -= n
                price[s] += cost(n)
                heap = [(price[x], x) for _, x in heap if room[x]]
                heapq.heapify(heap)
                put = True
                break
        for x in aside:
            heapq.heappush(heap, x)
        if not put:
            late.append(i)
    open_ = sorted((price[s], s) for s in range(many) if room[s])
    k = 0
    for i in late:
        start, left = 0, int(lengths[i])
        while left:
            s = open_[k][1]
            n = min(left, room[s])
            out[s].append((i, start, n))
            room[s] -= n
            start, left = start + n, left - n
            if not room[s]:
                k += 1
    return out


def packer(path: str, capacity: int, linear: float, quadratic: float, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        made = 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, tokens
            rows: list[tuple] = []  # document, start, length, sequence, offset, its length, its cost
            cost = lambda n: linear * n + quadratic * float(n) * n
            sizes = np.array([len(x) for x in held], np.int64)
            for i, n in enumerate(sizes.tolist()):
                for start in range(0, n - capacity + 1, capacity):
                    rows.append((i, start, capacity, base + made, 0, capacity, cost(capacity)))
                    made += 1
            rest = sizes % capacity
            which = np.flatnonzero(rest)
            for members in balance(rest[which], capacity, linear, quadratic):
                full, dear, at = sum(x[2] for x in members), sum(cost(x[2]) for x in members), 0
                for piece, start, n in members:
                    i = int(which[piece])
                    rows.append((i, int(sizes[i] - rest[i]) + start, n, base + made, at, full, dear))
                    at += n
                made += 1
            for k in range(0, len(rows), 2000):
                part = rows[k : k + 2000]
                i, start, length, sequence, offset, full, dear = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[x] for x in i], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([held[x][s : s + n].tobytes() for x, s, n in zip(i, start, length)], pa.binary()),
                        pa.array(sizes[list(i)], pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array(full, pa.int64()),
                        pa.array(dear, pa.float64()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
            docs.clear()
            held.clear()
            tokens = 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(0)
                docs.append(doc)
                held.append(np.array(ids, "<u4"))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush()
        yield from flush()

    return run


def pack(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = 4_000_000,
) -> DataFrame:
    """Packs whole texts into sequences of at most ``capacity`` tokens.

    A document is its token ids and then id 0. Every full ``capacity`` of a document
    is a sequence of its own; the remainders are packed by cost, ``linear`` per
    token plus ``quadratic`` per squared piece, in blocks of about ``block_tokens``
    tokens of one input partition. A block leaves fewer than ``capacity`` tokens of
    padding. There is no shuffle, and memory is bounded by a block and one document.

    Result, a row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id (unique; input partition and running number),
    offset, sequence_length, sequence_cost. A null or empty text is the single id 0.
    A null id stays null. Repeated rows are packed each for itself; an empty
    table gives no rows. Other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    run = packer(path, capacity, linear, quadratic, block_tokens)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(run, SCHEMA)
