"""Near duplicates: alignment and classes against brute force, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlweave.llm import alignment, near_dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_distances_against_the_full_table():
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = [r.randint(1, 4) for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 12)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = [r.randint(1, 5) for _ in range(r.randint(0, 2))]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    limit = np.array([r.randint(0, 30) for _ in pairs])
    got = alignment.distances(pairs, limit)
    for (a, b), g, top in zip(pairs, got, limit):
        d = edit(a.tolist(), b.tolist())
        assert g == (d if d <= top else top + 1)


def groups(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows, true, n = [], {}, 0
    for g in range(30):
        base = [word() for _ in range(r.randint(40, 200))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 25)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            true[n] = g
            n += 1
    return rows, true


def test_classes_against_brute_force(spark):
    rows, true = groups(spark)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {i: t.split() for i, t in rows}
    near = {i: {j for j in tokens if j == i or edit(tokens[i], tokens[j]) <= int(0.2 * max(len(tokens[i]), len(tokens[j])))} for i in tokens}
    root = {i: i for i in tokens}
    for _ in tokens:
        root = {i: min(root[j] for j in near[i]) for i in tokens}
    assert {i: x["class_id"] for i, x in got.items()} == root


def test_odd_inputs(spark):
    schema = "doc_id long, text string, root string, links string, tid string"
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    near = base[:50] + ["zzz"] + base[51:]
    rows = [(1, None), (2, ""), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(base)), (5, " ".join(base)), (None, " ".join(base).upper()), (6, "1234567 89"), (7, "12 3"), (8, "x"), (9, " ".join(base) * 300), (10, "y"), (5, "x y z")]
    df = spark.createDataFrame([(i, t, "r", "l", "k") for i, t in rows], schema)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    assert by[1][0]["class_id"] == by[2][0]["class_id"] == 1 and by[1][0]["copies"] == 2
    assert {x["class_id"] for i in (3, 4, None) for x in by[i]} == {3} and by[4][0]["links"] >= 1
    assert by[3][0]["copies"] == 3 and by[3][0]["class_size"] == 5
    assert by[8][0]["class_id"] == 8 and by[10][0]["class_id"] == 10 and by[9][0]["class_id"] == 9
    stay = near_dedup.keep_one(df)
    assert stay.columns == df.columns
    assert sorted((x["doc_id"], x["text"][:3] if x["text"] else x["text"]) for x in stay.collect()) == sorted([(1, None), (3, "waa"), (6, "123"), (7, "12 "), (8, "x"), (9, "waa"), (10, "y"), (5, "x y")], key=lambda p: p[0])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("at_driver", [1000, 0])
def test_components(spark, at_driver):
    pairs = [(i, i + 1) for i in range(20, 40)] + [(1, 9), (9, 5), (100, 101)]
    links = spark.createDataFrame([(bytearray(a.to_bytes(2, "big")), bytearray(b.to_bytes(2, "big"))) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(x["tid"], "big"): int.from_bytes(x["root"], "big") for x in near_dedup.components(spark, links, at_driver).collect()}
    want = {i: 20 for i in range(20, 41)} | {1: 1, 5: 1, 9: 1, 100: 100, 101: 100}
    assert got == want


def test_copies_with_small_edits_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600").limit(40)
    edited = df.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.regexp_replace("text", r"^(\S+ \S+ )\S+", "$1changed").alias("text"))
    got = near_dedup.near_duplicates(df.select("doc_id", "text").union(edited))
    assert got.where("doc_id >= 1000000 AND class_id >= 1000000").count() == 0


def test_links_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(100)]
    texts = []
    for k in range(24):
        w = list(base) if k % 2 else [*base[:65], *reversed(base[65:])]
        for i in r.sample(range(100), 2 + k % 6):
            w[i] = word()
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["links"] for x in near_dedup.near_duplicates(df, samples=256).collect()}
    want = {i: sum(edit(a, b) <= 20 for j, b in enumerate(texts) if j != i) for i, a in enumerate(texts)}
    assert got == want and set(want.values()) == {11}


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_meet_once(spark, block):
    rows = spark.createDataFrame([(g, n, i) for g, n in ((1, 20), (2, 3)) for i in range(n)], "g long, n long, x long")
    got = near_dedup.met(rows, rows.withColumnRenamed("x", "y"), "g", block).select("g", "x", "y").collect()
    assert sorted(map(tuple, got)) == [(g, x, y) for g, n in ((1, 20), (2, 3)) for x in range(n) for y in range(n)]


def test_short_near_texts_always_share_a_key():
    r = random.Random(6)
    for _ in range(3000):
        a = [r.randint(1, 10**9) for _ in range(r.randint(1, 36))]
        b = list(a)
        for _ in range(int(0.2 * len(a))):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = [r.randint(1, 10**9) for _ in range(r.randint(0, 1))]
        if not 0 < len(b) <= 36 or edit(a, b) > int(0.2 * max(len(a), len(b))):
            continue
        one, two = (set(near_dedup.short_keys(np.array(x, np.uint64), 0.2, 36).tolist()) for x in (a, b))
        assert one & two, (a, b)


def pairs_at(r, words, edits, n):
    """Random texts, each with a copy in which so many words are others."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for _ in range(n):
        a = [word() for _ in range(words)]
        b = list(a)
        for i in r.sample(range(words), edits):
            b[i] = word()
        yield a, b


SIZES = [(words, share) for words in (10, 20, 29, 50, 200) for share in (0.1, 0.15, 0.2)]


def test_recall_of_near_pairs(spark):
    r = random.Random(7)
    rows, kind = [], {}
    for words, share in SIZES:
        for a, b in pairs_at(r, words, int(share * words), 40):
            kind[len(rows)] = words, share
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: sum(got[i + 1] == i for i in kind if kind[i] == k) / 40 for k in SIZES}
    print(found)
    assert all(found[k] == 1 if k[0] < 30 else found[k] >= 0.95 for k in SIZES), found


def test_the_lower_bound_is_one():
    r = random.Random(11)
    for _ in range(2000):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 20))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = [r.randint(0, 4) for _ in range(r.randint(0, 2))]
        assert alignment.least([(np.array(a, np.int32), np.array(b, np.int32))])[0] <= edit(a, b), (a, b)
