"""Sharding and top-k against brute force, odd inputs."""

import operator
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlweave.llm import sharding, topk


def test_minimax_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        sizes = np.array([r.randint(1, 30) for _ in range(r.randint(0, 12))], np.int64)
        k = r.randint(1, 5)
        cuts = sharding.minimax(sizes, k)
        got = max((int(sizes[a:b].sum()) for a, b in zip(cuts, cuts[1:])), default=0)
        n = len(sizes)
        best = [[0] + [10**9] * n] + [[0] * (n + 1) for _ in range(k)]
        for j in range(1, k + 1):
            best[j] = [min(max(best[j - 1][i], int(sizes[i:m].sum())) for i in range(m + 1)) for m in range(n + 1)]
        assert len(cuts) == k + 1 and cuts[0] == 0 and cuts[-1] == n and got == best[k][n]


@pytest.mark.parametrize("rows_per_run", [100_000, 7])
def test_shards(spark, rows_per_run):
    r = random.Random(4)
    texts = [None, "", *("".join(r.choice("abcé ") for _ in range(r.randint(0, 60))) for _ in range(300))]
    texts += ["hot text"] * 150
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "n", 0), (1, "", 0), (5, texts[5], 0), (5, texts[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, shards=8, rows_per_run=rows_per_run).collect()
    assert len(got) == len(rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(8):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    home = {}
    for x in got:
        assert home.setdefault(x["text_crc32"], x["shard"]) == x["shard"]
    weight = Counter()
    for x in got:
        weight[x["shard"]] += x["size"]
    assert all(x["shard_bytes"] == weight[x["shard"]] for x in got)
    assert sharding.shard(df.limit(0)).count() == 0


def brute(rows, k):
    v = {}
    out = {}
    good = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for q, a in good:
        if q % 3:
            continue
        score = sorted(((sum(map(operator.mul, a, b)), i) for i, b in good if i != q and len(a) == len(b)), key=lambda p: (-p[0], p[1]))
        out[q] = [(s, i) for s, i in score[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_top_k(spark, broadcast_bytes):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.5, -0.3, 0.0, 0.25, 1.0, 2.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [1.0, 2.0]), (207, [2.0, 2.0]), (210, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int")
    for k in (1, 5, 300):
        got = {}
        for x in topk.top_k(df, F.col("vec_id") % 3 == 0, k=k, query_block=16, row_block=32, broadcast_bytes=broadcast_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
            assert x["rank"] == len(got[x["query_id"]])
        assert got == brute(rows, k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
