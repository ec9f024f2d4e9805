"""Toxicity: the index against brute force, held-out quality, odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlweave.llm import toxicity


def rows_of(r, n):
    out = []
    for i in range(n):
        y = int(i % 3 == 0)
        pool = np.arange(1, 400) if not y else np.concatenate([np.arange(1, 400), np.arange(400, 430).repeat(4)])
        h, count = np.unique(r.choice(pool, r.integers(5, 60)), return_counts=True)
        out.append((i, h.astype(np.uint64), count.astype(np.int64), y))
    return out


def plain(rows, shrink, power):
    """The weight of each term from its definition, as a function of a bag of words; terms that no row has included."""
    n, pos = len(rows), sum(r[3] for r in rows)
    df, with_pos = {}, {}
    for _, h, _, y in rows:
        for t in h.tolist():
            df[t] = df.get(t, 0) + 1
            with_pos[t] = with_pos.get(t, 0) + y
    share = pos / n

    def vector(bag):
        out = {}
        for t, k in bag.items():
            d, a = df.get(t, 0), with_pos.get(t, 0)
            told = abs(math.log((a + shrink * share) / (d - a + shrink * (1 - share))) - math.log(share / (1 - share)))
            out[t] = (1 + math.log(k)) * (math.log((1 + n) / (1 + d)) + 1) * (toxicity.LEAST + told) ** power
        size = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / size for t, v in out.items()}

    return vector


@pytest.mark.parametrize("shrink,power", [(10.0, 2.0), (30.0, 1.0)])
def test_nearest_against_brute_force(shrink, power):
    r = np.random.default_rng(4)
    rows = rows_of(r, 300)
    index = toxicity.build(rows, 7, 16, shrink, power)
    assert len(index.terms) == len({t for x in rows for t in x[1].tolist()}) and len(index.label) == 300 and set(index.label.tolist()) == {0, 1}
    assert (index.row >= 0).any() and (index.row < 0).any()
    vector = plain(rows, shrink, power)
    known = {i: vector(dict(zip(h.tolist(), n.tolist()))) for i, h, n, _ in rows}
    texts = [r.choice(np.arange(1, 600), r.integers(1, 50)).astype(np.uint64) for _ in range(60)] + [np.array([999_999], np.uint64)]
    seen = set()
    for at, example, cosine in index.search(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts), most=300):
        for i, e, c in zip(at.tolist(), example, cosine):
            seen.add(i)
            kinds, count = np.unique(texts[i], return_counts=True)
            own = vector(dict(zip(kinds.tolist(), count.tolist())))
            full = np.array([round(sum(v * known[w].get(t, 0.0) for t, v in own.items()) * 10**9) for w in index.who.tolist()])
            want = np.lexsort((np.arange(len(full)), -full))[:7]
            want = want[full[want] > 0]
            assert e[e >= 0].tolist() == want.tolist() and np.allclose(c[e >= 0], full[want] / 10**9)
    assert seen == set(range(60))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.score(docs, labels).withColumn("own", F.size("toxicity.evidence")).cache()
    got = scored.join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    x = {(r["toxic"], r["p"]): r["n"] for r in got.groupBy("toxic", F.col("toxicity.predicted").alias("p")).agg(F.count("*").alias("n")).collect()}
    recall = x.get((1, 1), 0) / (x.get((1, 1), 0) + x.get((1, 0), 0))
    false = x.get((0, 1), 0) / (x.get((0, 1), 0) + x.get((0, 0), 0))
    print("held-out recall", recall, "false", false)
    assert recall > 0.6 and false < 0.01, x
    assert scored.where("own = 0 AND length(text) > 20").count() < 0.01 * scored.count()  # texts have neighbours
    scored.unpersist()


def test_odd_inputs(spark):
    docs = [(i, ("you are trash and a moron " if i % 4 == 0 else "you are kind and a friend ") * (1 + i % 3), "a") for i in range(200)]
    docs += [(None, "trash moron", "b"), (900, None, None), (901, "", None), (902, "... 12", None), (8, "you are trash and a moron", "x"), (8, "you are trash and a moron", "x"), (903, "trash moron " * 30000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(None, 1, 1), (3, None, 1), (12, 0, 0), (5, 7, 0)], "doc_id long, toxic int, label int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(docs)
    by = {(x["doc_id"], x["text"] and x["text"][:5]): x["toxicity"] for x in got}
    assert by[(None, "trash")]["predicted"] == 1 and by[(903, "trash")]["predicted"] == 1 and by[(8, "you a")]["predicted"] == 1
    assert by[(900, None)]["predicted"] == by[(901, "")]["predicted"] == by[(902, "... 1")]["predicted"] == 0
    assert by[(1, "you a")]["predicted"] == 0 and all(0 <= x["toxicity"]["score"] <= 1 for x in got)
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert {x["toxicity"]["score"] for x in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
