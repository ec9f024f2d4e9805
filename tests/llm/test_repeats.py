"""Substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from marlweave.llm import block_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(units, width, join):
    """Kept units, removed count and maximal runs of each sequence of units."""
    seen = Counter()
    for u in units:
        for i in range(len(u) - width + 1):
            seen[tuple(u[i : i + width])] += 1
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (10, 20, 36, 60, 90)]
    out = [None, "", " \n", "a", "a " * 200, "ab" * 300, passages[3], passages[3]]
    for _ in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 2)
            parts += [p[cut:] if r.random() < 0.5 else p, text(r.randint(0, 20))]
        out.append(" ".join(parts))
    copies = [r.choice(out[8:]) for _ in range(8)]
    for t in copies[:5]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "xx"
        out.append(" ".join(w))
    return out + copies


def rows(df):
    out = {}
    for x in df.collect():
        out.setdefault(x["doc_id"], []).append((x["n"], x["removed"], len(x["spans"]), hashlib.sha256(bytes(x["kept"])).hexdigest()))
    return out


@pytest.mark.parametrize("most_kinds", [20_000, 2])
@pytest.mark.parametrize("width,gram", [(35, 10), (12, 4)])
def test_words(spark, width, gram, most_kinds):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, h string, tid string")
    got = rows(block_dedup.dedup_words(df, width=width, gram=gram, most_kinds=most_kinds))
    want = brute([[w.encode() for w in WORD.findall(t or "")] for t in texts], width, b" ".join)
    assert [got[i] for i in range(len(texts))] == [[x] for x in want]


@pytest.mark.parametrize("most_kinds", [20_000, 2])
@pytest.mark.parametrize("width,gram", [(60, 15), (150, 40)])
def test_bytes(spark, width, gram, most_kinds):
    texts = corpus(6)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = rows(suffix_dedup.dedup_bytes(df, width=width, gram=gram, most_kinds=most_kinds))
    want = brute([(t or "").encode() for t in texts], width, bytes)
    assert [got[i] for i in range(len(texts))] == [[x] for x in want]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "q")], "doc_id long, text string")
    got = rows(block_dedup.dedup_words(df, width=4, gram=2))
    assert [x[:2] for x in got[1]] == [(5, 5), (5, 5)] and got[2][0][:2] == (1, 0)
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0


def test_against_brute_force_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = df.select("doc_id", "text").collect()
    got = rows(suffix_dedup.dedup_bytes(df))
    width, seen = 400, Counter()
    raw = [(x["text"] or "").encode() for x in texts]
    for b in raw:
        seen.update(hash(b[i : i + width]) for i in range(len(b) - width + 1))
    for x, b in zip(texts, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert got[x["doc_id"]][0][1] == sum(gone) and got[x["doc_id"]][0][3] == hashlib.sha256(kept).hexdigest()


def test_many_copies_of_a_text(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600))
    other = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600))
    df = spark.range(10_000).selectExpr("id AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(10_000, other), (10_001, text[:90] + "x")], "doc_id long, text string"))
    for dedup, size in ((suffix_dedup.dedup_bytes, len(text)), (block_dedup.dedup_words, 600)):
        got = {(x["n"], x["removed"]): x["count"] for x in dedup(df).groupBy("n", "removed").count().collect()}
        assert got[size, size] >= 10_000 and sum(got.values()) == 10_002


def test_a_passage_shorter_than_the_width_that_begins_texts_and_stands_in_another(spark):
    """What begins two texts and stands inside a third is no repeat as long as it is shorter than the width."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    cases = [(400, 100, text(380)), (60, 15, text(55)), (60, 15, ("und " * 14)[:55])]
    for width, gram, passage in cases:
        texts = [passage + "x" + text(2 * width), passage + "y" + text(2 * width), text(2 * width) + "z" + passage + "z" + text(width)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = rows(suffix_dedup.dedup_bytes(df, width=width, gram=gram))
        want = brute([t.encode() for t in texts], width, bytes)
        assert [x[1] for x in want] == [0, 0, 0]
        assert [got[i] for i in range(len(texts))] == [[x] for x in want]
