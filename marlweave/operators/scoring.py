"""The best chunks of each question of a batch, scored where a chunk lies: only the hits of each task are shuffled.

Texts are read once, for how often each asked term stands in each chunk. What is kept of a chunk is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("title", "body", "memory")
LENGTHS = [f"len_{f}" for f in FIELDS]
TIMES = [f"tf_{f}" for f in FIELDS]
ROWS = "slot long, " + ", ".join(f"{c} long" for c in LENGTHS) + ", term array<int>, " + ", ".join(f"{c} array<int>" for c in TIMES)
#: Terms, rows of (question, term) and hits of a question that a task may hold; beyond them scores are summed by a shuffle.
TERMS, ASKED, MOST = 200_000, 2_000_000, 1_000
#: Questions of a pass, and scores (question by chunk) that are held at once.
QUESTIONS, BLOCK = 4096, 1 << 21
#: Bytes of text that are searched at once.
BYTES = 1 << 18


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of values by row; rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def stem(word: str) -> str:
    """``functions.text.s_stem`` of a word."""
    if len(word) > 3 and word.endswith("ies") and word[-4] not in "ae":
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] not in "su" else word


def forms(term: str) -> list[str]:
    """The words that have this stem."""
    every = {term, f"{term}s", *([f"{term[:-1]}ies"] if term.endswith("y") else [])}
    return sorted(w for w in every if stem(w) == term)


class Words:
    """Finds the words (runs of a to z and 0 to 9) of known terms in lower texts, as bytes, by a rolling hash, and compares what it finds."""

    LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))

    def __init__(self, terms: list[str]) -> None:
        known = [(w.encode(), i) for i, t in enumerate(terms) if t.isascii() and t.isalnum() for w in forms(t)]
        self.widest = max((len(w) for w, _ in known), default=0)
        self.base = 0x9E3779B97F4A7C15
        while True:
            self.up = self.down = np.ones(1, np.uint64)
            codes = np.array([self.hash(w) for w, _ in known], np.uint64)
            if len(np.unique(codes)) == len(codes):
                break
            self.base += 0x1000003D2
        order = np.argsort(codes)
        self.codes, self.term = codes[order], np.array([i for _, i in known], np.int64)[order]
        self.size = np.array([len(w) for w, _ in known], np.int64)[order]
        self.body = np.zeros((len(known), max(self.widest, 1)), np.uint8)
        for row, k in enumerate(order):
            self.body[row, : len(known[k][0])] = np.frombuffer(known[k][0], np.uint8)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.full((2, n), [[self.base], [pow(self.base, -1, 1 << 64)]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)

    def hash(self, word: bytes) -> int:
        return sum((c + 1) * pow(self.base, i, 1 << 64) for i, c in enumerate(word)) & (1 << 64) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of words of each text, row, term) of texts that start at ``starts`` in ``data``."""
        letter = self.LETTERS[data]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        cut = starts[starts < len(data)]
        first[cut] = letter[cut]
        before = cut[cut > 0] - 1
        last[before] = letter[before]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(starts, begin, side="right") - 1
        sizes = np.bincount(row, minlength=rows)
        if not len(self.codes):
            return sizes, row[:0], row[:0]
        self.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        short = end - begin <= self.widest
        begin, end, row = begin[short], end[short], row[short]
        code = (total[end] - total[begin]) * self.down[begin]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = (self.codes[at] == code) & (self.size[at] == end - begin)
        begin, row, at = begin[met], row[met], at[met]
        right = np.ones(len(at), bool)
        for i in range(int(self.size[at].max(initial=0))):
            some = np.flatnonzero(self.size[at] > i)
            right[some] &= data[begin[some] + i] == self.body[at[some], i]
        return sizes, row[right], self.term[at[right]]


def of_texts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """A row for each chunk: its lengths, and the asked terms (as their places in ``terms``) with their counts by field.

    texts: slot, and of each field the lower text, and the tokens (``_more``) that are no words of a to z and 0 to 9.
    """
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = sent.value
        words, known, many = Words(terms), pa.array(terms, pa.string()), max(len(terms), 1)
        for batch in batches:
            n, keys_of, sizes = batch.num_rows, [], []
            for f in FIELDS:
                column, more = batch[f], batch[f"{f}_more"]
                if column.type != pa.large_string():
                    column = column.cast(pa.large_string())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
                size, found, at = np.diff(more.offsets.to_numpy()).astype(np.int64), [], 0
                extra = pc.index_in(more.flatten(), value_set=known).fill_null(-1).to_numpy()
                found.append((np.repeat(np.arange(n, dtype=np.int64), size) * many + extra)[extra >= 0])
                while at < n:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
                    here, row, term = words.find(data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], to - at)
                    size[at:to] += here
                    found.append((row + at) * many + term)
                    at = to
                keys_of.append(np.concatenate(found))
                sizes.append(pa.array(size))
            keys, place = np.unique(np.concatenate(keys_of), return_inverse=True)
            field = np.repeat(np.arange(3), [len(x) for x in keys_of])
            row = keys // many
            out = [batch["slot"], *sizes, lists(row, keys - row * many, n)]
            out += [lists(row, np.bincount(place[field == k], minlength=len(keys)), n) for k in range(3)]
            yield pa.RecordBatch.from_arrays(out, ["slot", *LENGTHS, "term", *TIMES])

    return texts.select(F.col("slot").cast("long").alias("slot"), *FIELDS, *[f"{f}_more" for f in FIELDS]).mapInArrow(run, ROWS)


def postings(docs: DataFrame) -> DataFrame:
    """(slot, term, tf_title, tf_body, tf_memory) of tokenized chunks with different slots, counted where a chunk lies."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [part[f"{f}_tokens"] for f in FIELDS]
                every = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                many = max(len(every.dictionary), 1)
                sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
                row = np.concatenate([np.repeat(np.arange(part.num_rows), s) for s in sizes]).astype(np.int64)
                field = np.repeat(np.arange(3), [int(s.sum()) for s in sizes])
                keys, place = np.unique(row * many + every.indices.to_numpy(), return_inverse=True)
                times = [pa.array(np.bincount(place[field == k], minlength=len(keys)).astype(np.int64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part["slot"].take(pa.array(keys // many)), every.dictionary.take(pa.array(keys % many)), *times], ["slot", "term", *TIMES])

    return docs.select("slot", *[f"{f}_tokens" for f in FIELDS]).mapInArrow(run, f"slot {docs.schema['slot'].dataType.simpleString()}, term string, " + ", ".join(f"{c} long" for c in TIMES))


def of_index(postings: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """The same of an inverted index."""
    at = docs_of(postings.sparkSession, terms)
    held = postings.join(F.broadcast(at), "term").groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("at", *[F.col(c).cast("int").alias(c) for c in TIMES]))).alias("x"))
    rows = lengths.select("slot", *LENGTHS).join(held, "slot", "left")
    none = F.array().cast("array<int>")
    return rows.select("slot", *LENGTHS, *[F.coalesce(F.col(f"x.{c}"), none).alias("term" if c == "at" else c) for c in ("at", *TIMES)])


def docs_of(spark, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, at int")


def repeats(rows: DataFrame) -> bool:
    """Whether two chunks have the same slot."""
    return bool(rows.groupBy("slot").count().where("count > 1").limit(1).count())


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, term and counts of every posting of a batch."""
    size = np.diff(batch["term"].offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), size)
    return row, batch["term"].flatten().to_numpy(), [batch[c].flatten().to_numpy() for c in TIMES]


def frequencies(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(at, df, df_body, dfe): chunks with a term in title or body, in the body, in memory."""
    many = len(terms)

    def run(batches):
        total = np.zeros((3, many), np.int64)
        for batch in batches:
            _, term, (title, body, memory) = flat(batch)
            for k, some in enumerate((title + body > 0, body > 0, memory > 0)):
                total[k] += np.bincount(term[some], minlength=many)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x[at]) for x in total]], ["at", "df", "df_body", "dfe"])

    part = rows.select("term", *TIMES).mapInArrow(run, "at int, df long, df_body long, dfe long")
    return part.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("df", "df_body", "dfe")])


@dataclass(frozen=True)
class Law:
    """How a posting weighs: the rarity of each term, averages of lengths, and settings."""

    rarity: np.ndarray
    averages: tuple[float, float, float]
    fielded: bool
    k1: float
    b: float
    weights: tuple[float, float, float]

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of the postings that count."""
        row, term, times = flat(batch)
        share = lambda k: 1 - self.b + self.b * (np.maximum(batch[LENGTHS[k]].to_numpy(), 1) / self.averages[k])[row]
        if self.fielded:
            tf = self.weights[0] * times[0] / share(0) + self.weights[1] * times[1] / share(1) + self.weights[2] * times[2]
            return row, term, self.rarity[term] * tf * (self.k1 + 1) / (self.k1 + tf)
        some = times[1] > 0
        row, term, tf, long = row[some], term[some], times[1][some], share(1)[some]
        return row, term, self.rarity[term] * (self.k1 + 1) * tf / (tf + self.k1 * long)


class Presence:
    """Every term that a body has weighs 1."""

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, term, times = flat(batch)
        some = times[1] > 0
        return row[some], term[some], np.ones(int(some.sum()))


class Hits:
    """The ``k`` best (score, slot) of each list over blocks; scores are whole billionths."""

    def __init__(self, many: int, k: int) -> None:
        self.k, self.floor = k, np.ones(many)
        self.q, self.slot, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, at: np.ndarray, score: np.ndarray, slots: np.ndarray) -> None:
        """score: a row for each list ``at``, a column for each slot; below 1 is no hit."""
        if score.shape[1] > self.k:
            low = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            self.floor[at] = np.maximum(self.floor[at], low)
        q, row = np.nonzero(score >= self.floor[at][:, None])
        every = [np.concatenate(x) for x in ((self.q, at[q]), (self.slot, slots[row]), (self.score, score[q, row]))]
        order = np.lexsort((every[1], -every[2], every[0]))
        every = [x[order] for x in every]
        place = np.arange(len(order)) - np.searchsorted(every[0], every[0])
        last = place == self.k - 1
        self.floor[every[0][last]] = np.maximum(self.floor[every[0][last]], every[2][last])
        self.q, self.slot, self.score = (x[place < self.k] for x in every)


def hits(rows: DataFrame, law: Law | Presence, asked: list[tuple], kind: T.DataType, marked: set[int], k: int) -> DataFrame:
    """(query_id, slot, score, complete, low): the best of each task.

    asked: (query_id, [(place of term, times)]). With ``marked`` terms (places), chunks with a marked term of a question are lists of
    their own (complete), and a row without a slot tells the lowest score of those (low).
    """
    sent = rows.sparkSession.sparkContext.broadcast((law, asked, marked))
    wide = "long" if isinstance(kind, T.IntegralType) else kind.simpleString()
    arrow = pa.int64() if wide == "long" else None

    def run(batches):
        law, asked, marked = sent.value
        m = len(asked)
        of: dict[int, list[tuple[int, int]]] = {}
        for q, (_, terms) in enumerate(asked):
            for t, times in terms:
                of.setdefault(t, []).append((q, times))
        of_term = {t: tuple(np.array(x) for x in zip(*v, strict=True)) for t, v in of.items()}
        whole = np.array([any(t in marked for t, _ in terms) for _, terms in asked], dtype=bool)
        best, low = Hits(2 * m, k), np.full(m, np.inf)
        size = max(16, BLOCK // m)
        for batch in batches:
            row, term, weight = law.of(batch)
            slots = batch["slot"].to_numpy()
            order = np.lexsort((row, term, row // size))
            row, term, weight = row[order], term[order], weight[order]
            for start in range(0, batch.num_rows, size):
                part = slice(*np.searchsorted(row // size, [start // size, start // size + 1]))
                r, t, w = row[part] - start, term[part], weight[part]
                n = min(size, batch.num_rows - start)
                score, complete = np.zeros((m, n)), np.zeros((m, n), bool) if whole.any() else None
                cuts = np.flatnonzero(np.diff(t, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(t)], strict=False):
                    if int(t[a]) in of_term:
                        q, times = of_term[int(t[a])]
                        score[q[:, None], r[a:b]] += times[:, None] * w[a:b]
                        if int(t[a]) in marked:
                            complete[q[:, None], r[a:b]] = True
                score = np.rint(score * 1e9)
                own = slots[start : start + n]
                if complete is not None:
                    low = np.minimum(low, np.where(complete, score, np.inf).min(axis=1, initial=np.inf))
                    best.add(m + np.flatnonzero(whole), np.where(complete, score, 0)[whole], own)
                    score[complete] = 0
                best.add(np.arange(m), score, own)
        ids = pa.array([x for x, _ in asked], arrow)
        names = ["query_id", "slot", "score", "complete", "low"]
        q = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.q % m)), pa.array(best.slot), pa.array(best.score / 1e9), pa.array(best.q >= m), pa.nulls(len(best.q), pa.float64())], names)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.float64()), pa.array(np.ones(len(q), bool)), pa.array(low[q] / 1e9)], names)

    out = rows.mapInArrow(run, f"query_id {wide}, slot long, score double, complete boolean, low double")
    return out.withColumn("query_id", F.col("query_id").cast(kind))
