"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, blocks, mix, ranges, utf8, whole_text
from .langid import fold

STEP = U64(0x9E3779B97F4A7C15)
HEAD = 5
RESULT = "score double, predicted int, similarity double, evidence array<struct<example:long,label:int,similarity:double>>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of letters, in lower case) and the text it is in."""
    h, text, _, _ = words_and_heads(data, offsets)
    return h, text


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of the first HEAD letters of longer ones, with their texts."""
    h, text, head, at = words_and_heads(data, offsets)
    return np.concatenate([h, head]), np.concatenate([text, text[at]])


def words_and_heads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each word; hash of the head of each longer word, and which word that is."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    folded = fold(points)
    inside = folded != 32
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    start = inside & np.concatenate([[True], ~inside[:-1] | first[1:-1]])
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    code = mix(folded.astype(U64) + U64(1))
    stop = inside & np.concatenate([~inside[1:] | first[1:-1], [True]])
    ends = np.flatnonzero(stop) + 1
    # position weights inside the word: a sum of symbol times an odd number by place
    place = _places(starts, len(points))
    weight = mix((np.maximum(place, 0).astype(U64) + U64(7)) * STEP) | U64(1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(np.where(inside, code * weight, U64(0)), dtype=U64)])
    longer = np.flatnonzero(ends - starts > HEAD)
    head = mix((sums[starts[longer] + HEAD] - sums[starts[longer]]) ^ STEP)
    return mix(sums[ends] - sums[starts]), np.searchsorted(at, starts, side="right") - 1, head, longer


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.arange(n, dtype=np.int64)
    last = np.zeros(n, np.int64)
    last[starts] = starts
    return out - np.maximum.accumulate(last)


#: What cross-validation chooses from: how strongly few examples shrink a term's weight, and its power.
GRID = ((10.0, 2.0), (30.0, 1.0))
LEAST = 0.05


@dataclass
class Index:
    """Labelled examples as an inverted index of weights over blocks of examples, with their maxima.

    Every term of every example is in it. A term has a pair for each block with an example that holds it: pairs
    ``pair_at[t]`` to ``pair_at[t + 1]``, with the block and the largest weight there; the postings of
    pair p are ``post_at[p]`` to ``post_at[p + 1]``: example and weight. The lists of terms that many examples hold are
    rows of ``full`` (a column for each example) and ``full_most`` (for each block); ``row`` is -1 for the others.
    """

    terms: np.ndarray  # sorted hashes
    factor: np.ndarray  # what a term's frequency is multiplied by
    other: float  # the same for a term that no example holds
    pair_at: np.ndarray
    pair_block: np.ndarray
    pair_most: np.ndarray
    post_at: np.ndarray
    post_example: np.ndarray
    post_weight: np.ndarray
    row: np.ndarray
    full: np.ndarray
    full_most: np.ndarray
    label: np.ndarray
    who: np.ndarray
    k: int
    block: int
    prior: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def weights(self, h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight of all known terms of n texts (in order of text), the vectors of length one over all their terms."""
        kinds, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.terms, kinds), max(len(self.terms) - 1, 0))
        known = self.terms[at] == kinds if len(self.terms) else np.zeros(len(kinds), bool)
        key, count = np.unique(text * max(1, len(kinds)) + back, return_counts=True)
        doc, kind = key // max(1, len(kinds)), key % max(1, len(kinds))
        value = (1 + np.log(count)) * np.where(known[kind], self.factor[at[kind]] if len(self.terms) else 0.0, self.other)
        size = np.sqrt(np.bincount(doc, value * value, n))
        some = known[kind]
        doc, value = doc[some], value[some]
        return doc, at[kind[some]], value / size[doc]

    def nearest(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, begin: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k highest cosines of each of n texts, exactly, and the cosines; -1 and 0 where fewer are positive.

        Cosines count to nine places; ties go to the earlier example. The sum of a text's weights times the
        maxima of a block bounds its cosine with every example there. The ``begin`` blocks of the highest
        bounds are scored first, and then all others whose bound is not below the k-th best so far.
        """
        many, scale = len(self.label), 10**9
        blocks_ = -(-many // self.block)
        often = self.row[term] >= 0
        common = np.zeros((n, len(self.full)))
        common[doc[often], self.row[term[often]]] = value[often]
        doc, term, value = doc[~often], term[~often], value[~often]
        pairs = ranges(self.pair_at[term], self.pair_at[term + 1] - self.pair_at[term])
        entry = np.repeat(np.arange(len(term)), self.pair_at[term + 1] - self.pair_at[term])
        cell = doc[entry] * blocks_ + self.pair_block[pairs]
        bound = np.bincount(cell, value[entry] * self.pair_most[pairs], n * blocks_).reshape(n, blocks_) + common @ self.full_most
        score = np.zeros((n, many), np.int64)

        def add(chosen: np.ndarray) -> None:
            at = np.flatnonzero(chosen.ravel()[cell])
            p, e = pairs[at], entry[at]
            size = self.post_at[p + 1] - self.post_at[p]
            post, e = ranges(self.post_at[p], size), np.repeat(e, size)
            got = np.bincount(doc[e] * many + self.post_example[post], value[e] * self.post_weight[post], n * many).reshape(n, many)
            for b in range(blocks_):
                own, some = slice(b * self.block, (b + 1) * self.block), np.flatnonzero(chosen[:, b])
                if len(some):
                    score[some, own] = np.rint((got[some, own] + common[some] @ self.full[:, own]) * scale)

        first = np.zeros((n, blocks_), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :begin], True, axis=1)
        add(first)
        k = min(self.k, many)
        low = np.partition(score, many - k, axis=1)[:, many - k] if many else np.zeros(n, np.int64)
        add(~first & (bound > 0) & ((bound * scale).astype(np.int64) + 2 > low[:, None]))
        key = np.where(score > 0, score * many + (many - 1 - np.arange(many)), -1)
        best = -np.sort(-np.partition(key, many - k, axis=1)[:, many - k :], axis=1)
        if k < self.k:
            best = np.concatenate([best, np.full((n, self.k - k), -1, np.int64)], axis=1)
        found = best >= 0
        return np.where(found, many - 1 - best % max(1, many), -1), np.where(found, best // max(1, many) / scale, 0.0)

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The share of label 1 among the neighbours, weighted by closeness, as if both labels had as many examples; a half weighs a little."""
        pos = max(1, int(self.label.sum()))
        fair = np.where(self.label == 1, 0.5 * len(self.label) / pos, 0.5 * len(self.label) / max(1, len(self.label) - pos))
        near = cosine * cosine * np.where(example >= 0, fair[example], 0.0)
        return ((near * self.label[example]).sum(axis=1) + 0.005) / (near.sum(axis=1) + 0.01)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.curve)

    def search(self, h: np.ndarray, text: np.ndarray, n: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, examples, cosines) of those of n texts that share a term with an example, some at a time."""
        doc, term, value = self.weights(h, text, n)
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        rows, ends = doc[cuts], np.append(cuts[1:], len(doc))
        at = 0
        while at < len(rows):
            past = max(at + 1, min(at + 256, int(np.searchsorted(ends, cuts[at] + most, side="right"))))
            own = slice(cuts[at], ends[past - 1])
            local = np.repeat(np.arange(past - at), ends[at:past] - cuts[at:past])
            yield rows[at:past], *self.nearest(local, term[own], value[own], past - at)
            at = past


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising fit of y to x by pooling adjacent violators, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, n in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([a, b, n])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            p, q = pools.pop(), pools.pop()
            n = p[2] + q[2]
            pools.append([(p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


Row = tuple[int, np.ndarray, np.ndarray, int]  # id, hashes of features, counts, label


def flat(rows: list[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, counts and row of all rows."""
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])


def build(rows: list[Row], k: int, block: int, shrink: float = 10.0, power: float = 2.0) -> Index:
    """An index of all terms of all rows.

    A term's factor is its idf times a power of how much it tells about the label: LEAST, plus the distance of
    the log odds among the examples with it from those of all, shrunk by ``shrink`` examples of the usual mixture. So all
    terms count, and rare or neutral ones count little.
    """
    label = np.array([r[3] for r in rows], np.int64)
    n, pos = len(rows), int(label.sum())
    every, count, owner = flat(rows)
    kinds, back = np.unique(every, return_inverse=True)
    df = np.bincount(back, minlength=len(kinds)).astype(float)
    a = np.bincount(back, label[owner], len(kinds)) if n else df
    share = min(max(pos / max(1, n), 1e-3), 1 - 1e-3)
    told = np.abs(np.log((a + shrink * share) / (df - a + shrink * (1 - share))) - np.log(share / (1 - share)))
    factor = (np.log((1 + n) / (1 + df)) + 1) * (LEAST + told) ** power
    value = (1 + np.log(count)) * factor[back]
    value = value / np.sqrt(np.bincount(owner, value * value, max(1, n)))[owner]
    # examples that share their strongest term stand together, so that blocks have tight maxima
    strongest = np.zeros(n, np.int64)
    by = np.lexsort((value, owner))
    last = np.flatnonzero(np.diff(owner[by], append=-1))
    strongest[owner[by[last]]] = back[by[last]]
    order = np.lexsort((label, strongest))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    example = place[owner]
    at = np.lexsort((example, back))
    term, example, value = back[at], example[at], value[at]
    often = np.flatnonzero(df > max(n / 20, 1))
    row = np.full(len(kinds), -1)
    row[often] = np.arange(len(often))
    blocks_ = -(-n // block)
    full = np.zeros((len(often), n))
    held = row[term] >= 0
    full[row[term[held]], example[held]] = value[held]
    full_most = np.stack([full[:, b * block : (b + 1) * block].max(axis=1) for b in range(blocks_)], axis=1) if n else np.zeros((0, 0))
    term, example, value = term[~held], example[~held], value[~held]
    pair = np.flatnonzero(np.diff(term * (n + 1) + example // block, prepend=-1))
    return Index(
        terms=kinds,
        factor=factor,
        other=(np.log(1 + n) + 1) * LEAST**power,
        pair_at=np.searchsorted(term[pair], np.arange(len(kinds) + 1)),
        pair_block=(example[pair] // block).astype(np.int32),
        pair_most=np.maximum.reduceat(value, pair) if len(pair) else value,
        post_at=np.append(pair, len(term)),
        post_example=example.astype(np.int32),
        post_weight=value,
        row=row,
        full=full,
        full_most=full_most,
        label=label[order],
        who=np.array([r[0] for r in rows], np.int64)[order],
        k=k,
        block=block,
        prior=pos / max(1, n),
    )


def votes(index: Index, rows: list[Row]) -> np.ndarray:
    """The vote on each row; nan where no example shares a term."""
    every, count, owner = flat(rows)
    out = np.full(len(rows), np.nan)
    for at, example, cosine in index.search(np.repeat(every, count), np.repeat(owner, count), len(rows)):
        some = cosine[:, 0] > 0
        out[at[some]] = index.vote(example[some], cosine[some])
    return out


def choose(rows: list[Row], share: float, k: int, block: int, folds: int = 3) -> Index:
    """The index of all rows, with the settings of GRID that have the lowest log loss over ``folds`` folds of them.

    Votes on each fold by an index of the others also give the calibration, with labels weighted by their
    true shares (``share`` is that of label 1 at large).
    """
    label = np.array([r[3] for r in rows], np.int64)
    weight = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum()))
    fold = (mix(np.array([r[0] for r in rows], np.int64).view(U64)) % U64(folds)).astype(np.int64)
    best = None
    for shrink, power in GRID:
        raw = np.full(len(rows), np.nan)
        for f in range(folds):
            own = np.flatnonzero(fold == f)
            raw[own] = votes(build([r for r, x in zip(rows, fold) if x != f], k, block, shrink, power), [rows[i] for i in own])
        some = np.flatnonzero(~np.isnan(raw))
        if not len(some):
            continue
        curve = isotonic(raw[some], label[some].astype(float), weight[some])
        p = np.clip(np.interp(raw[some], *curve), 1e-4, 1 - 1e-4)
        loss = -float((weight[some] * np.where(label[some] == 1, np.log(p), np.log(1 - p))).sum())
        if best is None or loss < best[0]:
            none = np.isnan(raw)
            best = loss, shrink, power, curve, float((label * weight)[none].sum() / weight[none].sum()) if none.any() else share
    if best is None:
        index = build(rows, k, block)
        index.prior = share
        return index
    index = build(rows, k, block, best[1], best[2])
    index.curve, index.prior = best[3], best[4]
    return index


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i in range(batch.num_rows):
            own = offsets[i : i + 2]
            h, _ = features(data[own[0] : own[1]], own - own[0])
            kinds, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i : i + 1]), pa.array([kinds.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array(labels[i : i + 1].astype(np.int32))],
                names=["id", "h", "n", "label"],
            )


def train(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", examples: int = 3000, k: int = 15, block: int = 64) -> Index:
    """An index of at most ``examples`` labelled texts, as even between the labels as they allow.

    They are, of each label, the rows of the smallest hashes of ids, among rows whose id's CRC-32
    modulo 3 is not 1, with a text and a label 0 or 1. Ids with contradicting labels count as 1.
    Settings and calibration come from cross-validation among them.
    """
    known = labels.select(F.col(id_column).alias("i"), F.col(label_column).cast("int").alias("label")).where(F.col("i").isNotNull() & F.col("label").isin(0, 1) & ~held_out("i"))
    known = known.groupBy("i").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("i"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = examples // 2
    # what one label lacks the other may fill
    most = {0: max(half, examples - totals.get(1, 0)), 1: max(half, examples - totals.get(0, 0))}
    picks = [r for value in (0, 1) for r in known.where(F.col("label") == value).orderBy("order", "i").limit(most[value]).collect()]
    if not picks:
        return build([], k, block)
    # at most ``examples`` rows
    chosen = df.sparkSession.createDataFrame([(r["i"], r["label"]) for r in picks], T.StructType([T.StructField("i", labels.schema[id_column].dataType), T.StructField("label", T.IntegerType())]))
    texts = df.select(F.col(id_column).alias("i"), whole_text(text_column).alias("text")).join(F.broadcast(chosen), "i").dropDuplicates(["i"])
    got = texts.select(F.col("i").cast("long"), "text", "label").mapInArrow(count_words, "id long, h binary, n binary, label int").toPandas().sort_values("id")
    rows = [(int(i), np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64), int(y)) for i, h, n, y in zip(got["id"], got["h"], got["n"], got["label"])]
    return choose([r for r in rows if len(r[1])], totals.get(1, 0) / sum(totals.values()), k, block)


def score(df: DataFrame, labels: DataFrame | None = None, index: Index | None = None, id_column: str = "doc_id", text_column: str = "text", out: str = "toxicity", threshold: float = 0.7, shown: int = 3, **training) -> DataFrame:
    """Adds the struct ``out`` (score, predicted, similarity, evidence) to every row.

    A text is a vector over all its words, and the first letters of longer ones: TF-IDF, with each term weighed by
    what it tells about the labels (``build``). Its ``k`` nearest examples, of both labels, by exact cosine
    come from inverted lists whose blocks carry their maxima; their labels vote, weighted by squared
    cosine, and the vote is turned into a probability by an isotonic fit to votes on examples
    outside the index, at the labels' true shares. ``evidence`` lists the nearest examples.
    Predicted is 1 from ``threshold`` on.

    A text that is null, empty or shares no term with an example gets the share of label 1 among examples
    of that sort (if there were none, among all labelled). Whole texts count. All columns are kept; one named
    ``out`` is replaced; rows may repeat; an empty table stays empty. With no labels all scores are 0.
    """
    if index is None:
        index = train(df, labels, id_column, text_column, **training)
    shared = df.sparkSession.sparkContext.broadcast(index)
    kept = df.drop(out)
    at = kept.columns.index(text_column)
    item = pa.struct([("example", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("similarity", pa.float64()), ("evidence", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            n = batch.num_rows
            value, top, evidence = np.full(n, model.prior), np.zeros(n), [[] for _ in range(n)]
            for a, b in blocks(offsets, 1 << 20) if len(model.terms) else ():
                own = offsets[a : b + 1]
                for rows, example, cosine in model.search(*features(data[own[0] : own[-1]], own - own[0]), b - a):
                    some = cosine[:, 0] > 0
                    rows, example, cosine = rows[some], example[some], cosine[some]
                    value[a + rows] = model.calibrated(model.vote(example, cosine))
                    top[a + rows] = cosine[:, 0]
                    for i, e, s in zip((a + rows).tolist(), example[:, :shown].tolist(), cosine[:, :shown].tolist()):
                        evidence[i] = [{"example": int(model.who[x]), "label": int(model.label[x]), "similarity": y} for x, y in zip(e, s) if x >= 0]
            result = pa.StructArray.from_arrays([pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(top), pa.array(evidence, pa.list_(item))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StructType.fromDDL(RESULT))]))
