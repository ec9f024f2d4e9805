"""Packing: exact round trip, the two libraries' ids, balance against the rules."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marlweave.llm import packing


def check(texts, pieces, encode, capacity):
    """Every id of every text lies in exactly one piece, sequences are gapless; returns the padding."""
    by, seq = {}, {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
        seq.setdefault(p["sequence_id"], []).append(p)
    for i, t in texts.items():
        want = [*encode(t or ""), 0]
        own = sorted(by[i], key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == want
        assert all(p["doc_tokens"] == len(want) and p["length"] == len(p["ids"]) // 4 for p in own)
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
    for own in seq.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert sum(p["length"] for p in own) == own[0]["sequence_length"] <= capacity
    return sum(capacity - own[0]["sequence_length"] for own in seq.values())


def test_round_trip_on_a_table(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(df, block_tokens=100_000).collect()
    padding = check({x["doc_id"]: x["text"] for x in df.collect()}, pieces, lambda t: slow.encode(t, add_special_tokens=False).ids, 1024)
    assert padding < 1024 * (sum(p["length"] for p in pieces) // 100_000 + 9)


def test_added_tokens_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    fast = packing.encoder(packing.default_tokenizer())
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "hello", " ", "  ", "\n", "é", "'s", "<", "12"]
    assert fast("hello <|endoftext|> x") == slow.encode("hello <|endoftext|> x", add_special_tokens=False).ids and 50256 in fast("hello <|endoftext|> x")
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text


def test_odd_inputs(spark):
    odd = ["", None, "<|endoftext|> x", "é\U0001f600 ñ  \n\n a", "a " * 5000, "x" * 3000, "  lead", "don't I'll"]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(odd)], "doc_id long, text string, ids binary")
    encode = packing.encoder(packing.default_tokenizer())
    check(dict(enumerate(odd)), packing.pack(df, capacity=64).collect(), encode, 64)
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(same).count() == 3
    assert packing.pack(df.limit(0)).count() == 0


def test_balance_is_the_greedy_rule():
    r = random.Random(2)
    for _ in range(50):
        sizes = np.array([r.randint(1, 63) for _ in range(r.randint(1, 80))])
        got = packing.balance(sizes, 64, 1.0, 0.01)
        room, price, out, late = [64] * len(got), [0.0] * len(got), [[] for _ in got], []
        for i in np.argsort(-sizes, kind="stable").tolist():
            fit = [(price[s], s) for s in range(len(got)) if room[s] >= sizes[i]]
            if not fit:
                late.append(i)
                continue
            s = min(fit)[1]
            room[s] -= sizes[i]
            price[s] += sizes[i] + 0.01 * float(sizes[i]) ** 2
            out[s].append(i)
        assert len(got) == -(-int(sizes.sum()) // 64)
        assert [[i for i, start, n in s if i not in late] for s in got] == out
        assert all(sum(n for _, _, n in s) <= 64 for s in got)


def test_crc_of_ids(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    x = packing.pack(df).select("ids", F.crc32("ids").alias("c")).first()
    assert x["c"] == zlib.crc32(bytes(x["ids"]))
