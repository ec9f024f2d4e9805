"""Containment and numbering against brute force; shared relations against the general ranking; new metrics and citations."""

import random

from pyspark.sql import functions as F

from marlweave.operators import citations, fusion, metrics, mutation, numbering
from marlweave.operators.containment import contained


def test_contained_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: r.choice(["ab", "abc", "b", "ca", "x", "é", "the", "a.b", "|"])
    texts = [(i, r.choice(["", " ", "\n"]).join(word() for _ in range(r.randint(0, 12)))) for i in range(60)] + [(99, None), (100, "")]
    patterns = [(i, " ".join(word() for _ in range(r.randint(1, 5)))) for i in range(40)] + [(50, "a"), (51, "ab"), (52, ""), (53, None), (54, " "), (55, "zz"), (56, "b\nthe x")]
    got = contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")).collect()
    want = sorted((t, p) for t, x in texts for p, y in patterns if x is not None and y and y in x)
    assert sorted((g["text_id"], g["pattern_id"]) for g in got) == want and len(want) > 50


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = sorted((r["x"], r["n"]) for r in numbering.numbered(df, ["x"], "n", 5).collect())
    assert got == [(i, i + 5) for i in range(1000)]
    assert numbering.numbered(df.limit(0), ["x"], "n").count() == 0
    groups = mutation.hash_groups(df.select(F.col("x").alias("chunk_id")), "s", {"a": 3, "b": 2}).collect()
    assert sorted(r["group"] for r in groups) == ["a", "a", "a", "b", "b"]


def test_shared_relations_equal_the_general_ranking(spark):
    r = random.Random(2)
    names = ["river", "house", "cats", "dog", "stone", "tree"]
    rel = spark.createDataFrame([(f"{r.choice(names)} → has → {r.choice(names)} {i % 30}", i) for i in range(80)], "relation string, pos long")
    q = spark.createDataFrame([(1, "river stone cat"), (2, "nothing here"), (3, "tree dog house river"), (4, "")], "query_id long, question string")
    for limit in (3, 10, 40):
        one = fusion.rank_shared_relations(rel, q, limit)
        two = fusion.rank_relations(rel.crossJoin(q.select("query_id")), q, limit)
        key = lambda df: sorted(tuple(x[c] for c in ("query_id", "rank", "relation", "hits")) for x in df.collect())
        assert key(one) == key(two)


def test_other_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (2, "z", 1)], "query_id long, doc string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (1, "q"), (3, "x")], "query_id long, doc string")
    e = {r["query_id"]: r for r in metrics.end_to_end(ranked, gold, 2).collect()}
    assert (e[1]["hits"], e[1]["precision"], e[1]["rr"], e[1]["hit"], e[1]["all_gold"]) == (1, 0.5, 0.5, True, False) and e[3]["hits"] == 0 and 2 not in e
    s = {r["query_id"]: r for r in metrics.sessions(ranked, gold).collect()}
    assert (s[1]["retrieved"], s[1]["hits"], s[1]["rr"]) == (3, 2, 0.5) and abs(s[1]["ndcg"] - (1 / 1.584962500721156 + 0.5) / (1 + 1 / 1.584962500721156 + 0.5)) < 1e-9
    assert s[2]["eligible"] is False and s[2]["session_recall"] is None and s[3]["ndcg"] == 0.0


def test_citations(spark):
    rows = [("1", "A법", "제1조", "제2조 및 제2조에 따라 「B법」 제1조"), ("2", "A법", "제2조", "제2조 「없는법」 제1조의2 「없는법」제1조"), ("3", "B법", "제1조", "제9조")]
    got = citations.citations(spark.createDataFrame(rows, "doc_id string, law string, article_no string, text string")).collect()
    assert sorted((r["s"], r["o"]) for r in got) == [("1", "2"), ("1", "3"), ("2", "1")]
