"""Decontamination: places against a full edit-distance search, planted passages, odd inputs."""

import random

import numpy as np

from marlweave.llm import decontam


def norm(t):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())


def least(item, doc):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(doc, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)


def spoil(r, text, n):
    for _ in range(n):
        k = r.randrange(len(text))
        text = r.choice([text[:k] + text[k + 1 :], text[:k] + "q" + text[k:], text[:k] + "z" + text[k + 1 :]])
    return text


def test_against_full_search(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghié") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(6, 30))) for i in range(12)]
    docs = []
    for i in range(120):
        parts = [text(r.randint(0, 20))]
        if r.random() < 0.7:
            parts.append(spoil(r, r.choice(items)[1], r.choice([0, 0, 1, 3, 6, 10, 20])).upper() + r.choice(["!", ",  "]))
        docs.append((i, " ".join([*parts, text(r.randint(0, 20))])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for settings in ({}, {"chunk_items": 3}):
        got = {(x["doc_id"], x["item_id"]): x for x in decontam.find_leaks(df, bench, **settings).collect()}
        seen = set()
        for i, t in docs:
            for k, p in items:
                a = norm(p)
                d, top = least(a, norm(t)), decontam.budget(len(a), 10, 0.06)
                if d <= top:
                    seen.add((i, k))
                    assert got[(i, k)]["edits"] == d
                    x = got[(i, k)]
                    assert least(a, norm(t[x["begin"] : x["end"]])) == d
        assert set(got) == seen and len(seen) > 30


def test_benchmark_passages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    want = {(d, x["item_id"]) for x in bench.collect() for d, t in texts.items() if x["text"] in t}
    assert want <= got and len(got) <= len(want) + 5
    left = {x["doc_id"] for x in decontam.clean(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_odd_inputs(spark):
    p = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(1, None), (2, ""), (3, p), (3, p), (None, "x " + p + " y " + p), (4, "..."), (5, "word " * 40000 + p), (6, p[:20])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, p), (1, p), (2, None), (3, ""), (4, "short"), (None, p)], "item_id long, text string")
    got = [(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(df, bench).collect() if x["item_id"]]
    assert sorted({(str(d), i) for d, i in got}) == [("3", 1), ("5", 1), ("None", 1)]
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == 8
    assert np.array_equal(sorted(x["doc_id"] for x in decontam.clean(df, bench.where("item_id = 1")).collect()), [1, 2, 4, 6])


def test_counting_in_parts_gives_the_same():
    r = random.Random(3)
    items = decontam.index([0, 1, 2], ["a" * 60, "ab" * 40, "".join(r.choice("abc ") for _ in range(90))], 10, 0.06)
    text = "a" * 300 + " " + "ab" * 100 + "".join(r.choice("abc ") for _ in range(400))
    data = np.frombuffer(text.encode(), np.uint8)
    s, at, _ = decontam.symbols(data, np.array([0, len(data)]))
    whole = [x.tolist() for x in decontam.regions(items, s, at, 10)]
    assert len(whole[0]) > 5
    for most in (1, 100, 5000):
        assert [x.tolist() for x in decontam.regions(items, s, at, 10, most)] == whole


def test_clean_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a passage about nothing in particular at all", "x", 1), (2, None, "y", 2), (3, "other words", None, None)], "doc_id long, text string, key string, leak long")
    bench = spark.createDataFrame([(1, "passage about nothing in particular")], "item_id long, text string")
    got = decontam.clean(docs, bench)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]
