"""Language identification: held-out accuracy, the models' sums, and odd inputs."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marlweave.llm import langid


def test_distributions_sum_to_one():
    text = "the cat sat on the mat and the dog ate the hat " * 3
    s, _, _ = langid.symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    points = s[np.arange(len(s) - 3)[:, None] + np.arange(4)]
    kinds, count = np.unique(points, axis=0, return_counts=True)
    model = langid.fit({"en": (kinds, count.astype(float))})
    alphabet = np.unique(kinds)
    for context in ([32, 32, 32], [ord("t"), ord("h"), ord("e")], [ord("z"), ord("z"), ord("a")]):
        rows = np.array([[*context, a] for a in alphabet], np.uint64)
        total = np.exp(model.log_probability(rows)).sum()
        assert 0.9 < total <= 1.0 + 1e-6  # one share is kept for symbols never seen


def restated(texts, languages):
    """Interpolated Kneser-Ney from its definition, with dictionaries: a function text -> cross-entropies."""
    pad = " " * (langid.ORDER - 1)
    clean = lambda t: " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split(" "))

    def line(t):
        out = ""
        for c in clean(t):
            if c != " " or not out or out[-1] != " ":
                out += c
        return pad + out

    tables, alphabet = {}, set()
    for lang in languages:
        counts = Counter()
        for t, own in texts:
            if own == lang:
                s = line(t)
                counts.update(s[i : i + langid.ORDER] for i in range(len(s) - langid.ORDER + 1))
        alphabet |= {c for g in counts for c in g}
        levels = {}
        for order in range(langid.ORDER, 0, -1):
            ones, twos = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            total, kinds = Counter(), Counter()
            for g, v in counts.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            levels[order] = counts, discount, total, kinds
            lower = Counter()
            for g in counts:
                lower[g[1:]] += 1
            counts = lower
        tables[lang] = levels

    def entropy(t):
        out = []
        s = line(t)
        for lang in languages:
            total = 0.0
            for i in range(len(s) - langid.ORDER + 1):
                p = 1 / (len(alphabet) + 1)
                for order in range(1, langid.ORDER + 1):
                    g = s[i + langid.ORDER - order : i + langid.ORDER]
                    counts, discount, mass, kinds = tables[lang][order]
                    c = g[:-1]
                    if mass[c]:
                        p = max(counts[g] - discount, 0) / mass[c] * (g in counts) + discount * kinds[c] / mass[c] * p
                total -= math.log(p)
            out.append(total / (len(s) - langid.ORDER + 1))
        return out

    return entropy


def test_entropies_against_brute_force():
    r = random.Random(9)
    words = {"x": "der die und hund katze übel groß straße".split(), "y": "the and dog cat small house river of".split(), "z": "el la perro gato niño casa y río".split()}
    texts = [(" ".join(r.choice(words[k]) for _ in range(30)) + r.choice([".", " 12", ""]), k) for k in words for _ in range(8)]
    counts = {}
    for k in words:
        rows = np.concatenate([_points(t) for t, own in texts if own == k])
        kinds, n = np.unique(rows, axis=0, return_counts=True)
        counts[k] = kinds, n.astype(float)
    scorer = langid.Scorer(langid.fit(counts))
    odd = [t for t, _ in texts[:6]] + ["The Übel, house!", "qqq zzz", "a", "niño " * 50]
    raw = [t.encode() for t in odd]
    got, _, _ = scorer.entropies(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    entropy = restated(texts, sorted(words))
    want = np.array([entropy(t) for t in odd])
    assert np.allclose(got, want, atol=1e-4), np.abs(got - want).max()
    assert (got.argmin(axis=1) == want.argmin(axis=1)).all()


def _points(text):
    data = np.frombuffer(text.encode(), np.uint8)
    s, _, _ = langid.symbols(data, np.array([0, len(data)]))
    return s[np.arange(len(s) - langid.ORDER + 1)[:, None] + np.arange(langid.ORDER)]


def test_other_texts_are_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(4)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600)) for _ in range(20)]
    greek = ["".join(r.choice("αβγδεζηθικλμνξοπρστυφχψω   ") for _ in range(300)) for _ in range(20)]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(noise + greek)], df.schema)
    got = langid.identify(df.unionByName(more))
    assert got.where(f"doc_id >= {10**9} AND language.accepted").count() == 0
    assert got.where(f"doc_id < {10**9} AND NOT language.accepted AND length(text) > 0").count() <= 0.01 * df.count()


def test_held_out_accuracy_and_rejection(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df)
    held = got.where(langid.held_out("doc_id", 5))
    right, n, kept = held.agg(F.avg((F.col("language.pred") == F.col("lang")).cast("int")), F.count("*"), F.avg(F.col("language.accepted").cast("int"))).first()
    assert n > 100 and right > 0.97 and kept > 0.98
    assert got.columns == [*df.columns, "language"]


def test_odd_inputs(spark):
    schema = "doc_id long, text string, lang string, language string"
    rows = [(i, "der hund und die katze sind hier " * 3, "de", "x") for i in range(20)] + [(100 + i, "the dog and the cat are here " * 3, "en", "x") for i in range(20)]
    odd = [(None, "the dog", None, None), (900, None, "en", None), (901, "", None, "y"), (902, "123 ---", "de", "y"), (5, "der hund und", "de", "z"), (5, "der hund und", "de", "z"), (903, "a", None, None), (904, "the cat and the dog " * 20000, None, None)]
    got = {(x["doc_id"], x["text"] and x["text"][:9]): x["language"] for x in langid.identify(spark.createDataFrame(rows + odd, schema)).collect()}
    assert got[(None, "the dog")]["pred"] == "en" and got[(5, "der hund ")]["pred"] == "de" and got[(904, "the cat a")]["pred"] == "en"
    for key in ((900, None), (901, ""), (902, "123 ---")):
        assert got[key]["pred"] == "und" and got[key]["score"] == 0 and not got[key]["accepted"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
