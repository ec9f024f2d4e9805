"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import U64, blocks, mix, ranges, utf8

ORDER = 4
GAP = 32
STEP = U64(0x9E3779B97F4A7C15)
RESULT = "pred string, score double, cross_entropy double, symbols long, accepted boolean"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; GAP for all else."""
    out = np.full(1 << 16, GAP, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def fold(points: np.ndarray) -> np.ndarray:
    table = fold_table()
    if points.size and int(points.max()) >= len(table):
        far = points >= len(table)
        out = table[np.where(far, 0, points)]
        for c in np.unique(points[far]).tolist():
            if unicodedata.category(chr(c)).startswith("L"):
                out[points == c] = c
        return out
    return table[points]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in lower case with single gaps, each text after ORDER - 1 gaps.

    Returns the symbols, the offset of each text, and whether a text has a letter.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    folded = fold(points)
    gap = folded == GAP
    letters = np.concatenate([[0], np.cumsum(~gap)])
    some = letters[at[1:]] > letters[at[:-1]]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    inner = at[1:-1][at[1:-1] < len(keep)]
    keep[inner] = ~gap[inner]
    if len(keep):
        keep[0] = not gap[0]
    held = np.concatenate([[0], np.cumsum(keep)])[at]
    pad = ORDER - 1
    out = np.full(int(held[-1]) + pad * (len(at) - 1), GAP, np.uint64)
    starts = held[:-1] + pad * np.arange(len(at) - 1)
    out[ranges(starts + pad, np.diff(held))] = folded[keep]
    return out, np.append(starts, len(out)), some


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place from ORDER - 1 on."""
    n = len(s) - (ORDER - 1)
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for k in range(ORDER - order, ORDER):
        h = (h + s[k : k + n] + U64(1)) * STEP
    return mix(h)


@dataclass
class Model:
    """For each order sorted hashes of n-grams and contexts, and per language their weights."""

    languages: list[str]
    hashes: list[np.ndarray]
    weights: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 0.1
    limit: np.ndarray | None = None
    spread: float = 0.0

    def log_probability(self, points: np.ndarray) -> np.ndarray:
        """Of the last symbol of each row of ORDER symbols, for every language."""
        p = np.broadcast_to(self.floor, (len(points), len(self.languages))).astype(np.float64)
        for order in range(1, ORDER + 1):
            h, c = row_hash(points[:, ORDER - order :]), row_hash(points[:, ORDER - order : -1])
            p = found(self.hashes[order - 1], self.weights[order - 1], h, 0.0) + found(self.contexts[order - 1], self.backoff[order - 1], c, 1.0) * p
        return np.log(p)


def row_hash(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), U64)
    for k in range(points.shape[1]):
        h = (h + points[:, k] + U64(1)) * STEP
    return mix(h)


def found(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where((keys[at] == h)[:, None], values[at], missing)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney models from each language's distinct n-grams (rows of ORDER symbols) and counts."""
    languages = sorted(counts)
    parts: list[list] = [[] for _ in range(ORDER)]
    outer: list[list] = [[] for _ in range(ORDER)]
    alphabet = np.unique(np.concatenate([np.unique(p) for p, _ in counts.values()]))
    for number, name in enumerate(languages):
        points, count = counts[name]
        for order in range(ORDER, 0, -1):
            own = points[:, ORDER - order :]
            h, c = row_hash(own), row_hash(own[:, :-1])
            keys, first, group = np.unique(h, return_index=True, return_inverse=True)
            # below the highest order a count is the number of different symbols before
            mass = np.bincount(group, count if order == ORDER else None).astype(np.float64)
            ones, twos = (mass == 1).sum(), (mass == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            ctx, back = np.unique(c[first], return_inverse=True)
            total, kinds = np.bincount(back, mass), np.bincount(back)
            parts[order - 1].append((keys, number, np.maximum(mass - discount, 0) / total[back]))
            outer[order - 1].append((ctx, number, discount * kinds / total))
            # the next lower order counts the distinct n-grams of this one
            points, count = own[first], None
            pad = np.full((len(points), ORDER - own.shape[1]), GAP, np.uint64)
            points = np.concatenate([pad, points], axis=1)
    model = Model(languages, [], [], [], [], np.full(len(languages), 1.0 / (len(alphabet) + 1)))
    for rows, hashes, weights, missing in ((parts, model.hashes, model.weights, 0.0), (outer, model.contexts, model.backoff, 1.0)):
        for own in rows:
            keys = np.unique(np.concatenate([k for k, _, _ in own]))
            table = np.full((len(keys), len(languages)), missing, np.float32)
            for k, number, value in own:
                table[np.searchsorted(keys, k), number] = value
            hashes.append(keys)
            weights.append(table)
    return model


class Scorer:
    """Cross-entropies of texts under a model; n-grams met before are kept in a table by hash."""

    def __init__(self, model: Model, bits: int = 20) -> None:
        self.model = model
        self.mask = U64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, U64)
        self.row = np.zeros(1 << bits, np.int32)
        self.table = np.zeros((1, len(model.languages)), np.float32)
        self.used = 0

    def rows(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        out = np.where(self.key[slot] == h, self.row[slot], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            if self.used > 1 << 21:  # start over rather than grow without end
                self.key[:] = 0
                self.used = 0
                return self.rows(h, s)
            fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            points = s[at[:, None] + np.arange(ORDER)]
            value = self.model.log_probability(points).astype(np.float32)
            base = self.used
            if base + len(fresh) > len(self.table):
                more = np.zeros((max(len(self.table), len(fresh) + base), len(self.model.languages)), np.float32)
                self.table = np.concatenate([self.table, more])
            self.table[base : base + len(fresh)] = value
            self.used += len(fresh)
            out[miss] = base + back
            own = slot[at]
            self.key[own] = fresh
            self.row[own] = base + np.arange(len(fresh))
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, at, some = symbols(data, offsets)
        n = np.diff(at) - (ORDER - 1)
        out = np.full((len(n), len(self.model.languages)), np.nan)
        full = np.flatnonzero(n > 0)
        if len(full):
            h = grams(s, ORDER)
            row = self.rows(h, s)
            # the windows that begin in a text's padding of the next are skipped by the sums' ends
            starts, ends = at[full], at[full] + n[full]
            cut = np.empty(2 * len(full), np.int64)
            cut[0::2], cut[1::2] = starts, ends
            last = cut[-1] >= len(row)
            for k in range(len(self.model.languages)):
                value = self.table[row, k].astype(np.float64)
                sums = np.add.reduceat(value, cut[:-1] if last else cut)[0::2]
                out[full, k] = -sums / n[full]
        return out, n, some


def held_out(id_column: str, folds: int) -> Column:
    """Whether the id's fold is not learned from; an id that is null is in none."""
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for name in sorted(set(names)):
            for i in np.flatnonzero(names == name).tolist():
                own = offsets[i : i + 2]
                s, _, some = symbols(data[own[0] : own[1]], own - own[0])
                if not some.any():
                    continue
                points = s[np.arange(len(s) - ORDER + 1)[:, None] + np.arange(ORDER)].astype(np.uint32)
                kinds, count = np.unique(np.ascontiguousarray(points).view([("", np.uint32)] * ORDER).ravel(), return_counts=True)
                text = kinds.view(np.uint32).reshape(-1, ORDER).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(kinds)), pa.array([text[k : k + 4 * ORDER] for k in range(0, len(text), 4 * ORDER)], pa.binary()), pa.array(count.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5, fit_docs: int = 400, calibration_docs: int = 100) -> Model:
    """Learns from at most ``fit_docs`` whole texts of each language, calibrates on ``calibration_docs`` others.

    Both are chosen by the smallest hashes of ids, among rows with text, language and an id
    whose CRC-32 is not 0 modulo ``folds``. Only counts of n-grams reach the driver.
    """
    most = fit_docs + calibration_docs
    rows = df.select(F.col(id_column).alias("i"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("i").isNotNull() & ~held_out("i", folds)).withColumn("order", F.xxhash64("i"))
    first = rows.select("lang", "order").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("r") <= most)
    cuts = []
    for c in first.groupBy("lang").agg(F.sort_array(F.collect_list("order")).alias("orders")).collect():
        orders = c["orders"]
        cuts.append({"lang": c["lang"], "last": orders[-1], "fit": orders[min(fit_docs, -(-4 * len(orders) // 5)) - 1]})
    if not cuts:
        return Model([], [], [], [], [], np.zeros(0))
    pick = lambda name: F.coalesce(*[F.when(F.col("lang") == c["lang"], F.lit(c[name])) for c in cuts])
    sample = rows.where(F.col("order") <= pick("last"))
    counted = sample.where(F.col("order") <= pick("fit")).select("lang", "text").mapInArrow(list_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for name, own in counted.groupby("lang"):
        points = np.frombuffer(b"".join(map(bytes, own["gram"])), np.uint32).reshape(-1, ORDER).astype(np.uint64)
        order = np.lexsort(points.T)
        counts[name] = (points[order], own["n"].to_numpy(np.float64)[order])
    if not counts:
        return Model([], [], [], [], [], np.zeros(0))
    model = fit(counts)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = sample.where(F.col("order") > pick("fit")).select("lang", "text").mapInArrow(entropies_of(shared), "lang string, n long, ce array<double>").toPandas()
    shared.unpersist()
    calibrate(model, rest)
    return model


def entropies_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ce, n, some = scorer.entropies(data, offsets)
            at = np.flatnonzero(some)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n[at]), pa.array(ce[at].tolist(), pa.list_(pa.float64()))], names=["lang", "n", "ce"])

    return run


def calibrate(model: Model, rows: pd.DataFrame) -> None:
    """Sets the temperature of the scores, and each language's highest entropy of a text that is its own."""
    model.limit = np.full(len(model.languages), np.inf)
    rows = rows[rows["lang"].isin(model.languages)]
    if not len(rows):
        return
    ce = np.array(rows["ce"].tolist())
    true = np.array([model.languages.index(x) for x in rows["lang"]])
    n = rows["n"].to_numpy(np.float64)
    losses = []
    for t in np.geomspace(0.01, 1, 25):
        z = -(ce - ce.min(axis=1, keepdims=True)) / t
        losses.append((-(z[np.arange(len(z)), true] - np.log(np.exp(z).sum(axis=1))).mean() + 1e-4 / t, t))
    model.temperature = min(losses)[1]
    own = ce[np.arange(len(ce)), true]
    every = own[n >= 200]
    for k in range(len(model.languages)):
        mine = own[(true == k) & (n >= 200)]
        mine = mine if len(mine) >= 20 else every  # a language of few such texts is held to all languages' limit
        if len(mine):
            # a high quantile, so that one odd or mislabelled text does not set the limit
            middle, high = float(np.median(mine)), float(np.quantile(mine, 0.95))
            model.limit[k] = high + max(0.35, 2 * (high - middle))
    model.spread = 6.0  # nats a symbol: short texts vary by this over the root of their length


def identify(df: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", out: str = "language", **training) -> DataFrame:
    """Adds the struct ``out`` (pred, score, cross_entropy, symbols, accepted) to every row.

    Each language is an interpolated Kneser-Ney model of characters (letters in lower case,
    gaps between), stored as sorted hash arrays of n-grams and of contexts. The prediction is the
    language of the lowest cross-entropy per symbol of the whole text; ties go to the first name.
    ``score`` is its share under a softmax whose temperature is set on other texts than
    those the models are fitted to. A text is rejected (``accepted`` false) if it has no
    letter, or if its entropy is above what calibration texts of that language reach,
    with room that grows for short texts.

    Null text or no letter: pred 'und', score 0, not accepted. If nothing can be learned, the
    same. All columns are kept; one named ``out`` is replaced. Repeated rows are rows; an
    empty table stays empty. Without ``model`` one is trained on ``df``.
    """
    if model is None:
        model = train(df, id_column, text_column, lang_column, **training)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(out)
    at = kept.columns.index(text_column)
    kind = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("symbols", pa.int64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m) if m.languages else None
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            rows = batch.num_rows
            pred, score, entropy = np.full(rows, "und", dtype=object), np.zeros(rows), np.full(rows, np.nan)
            count, accepted = np.zeros(rows, np.int64), np.zeros(rows, bool)
            for a, b in blocks(offsets, 1 << 20) if scorer else ():
                own = offsets[a : b + 1]
                ce, n, some = scorer.entropies(data[own[0] : own[-1]], own - own[0])
                who = np.flatnonzero(some)
                if not len(who):
                    continue
                ce = ce[who]
                best = ce.argmin(axis=1)
                low = ce[np.arange(len(ce)), best]
                score[a + who] = 1 / np.exp(-(ce - low[:, None]) / m.temperature).sum(axis=1)
                pred[a + who] = np.array(m.languages, dtype=object)[best]
                entropy[a + who], count[a + who] = low, n[who]
                accepted[a + who] = low <= (m.limit[best] if m.limit is not None else np.inf) + m.spread / np.sqrt(n[who])
            result = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(count), pa.array(accepted)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StructType.fromDDL(RESULT))]))
