"""Steps that must not grow faster than their input, each against its plain form."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlweave.functions.vectors import cosine
from marlweave.operators import dense, rerank, scoring
from marlweave.operators import lexical as ranking
from marlweave.queries import lexical as registered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_dense(c, q, k):
    rows = c.where("embedding IS NOT NULL").crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "slot", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slot"))).where(F.col("rank") <= k)


def same(a, b, *columns):
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))
    assert rows(a) == rows(b)


def test_dense_search_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    vector = lambda: [r.choice([-1.0, 0.0, 0.5, 2.0, r.random()]) for _ in range(r.choice([3, 4, 4, 4, 7]))]
    few = [vector() for _ in range(40)]
    c = spark.createDataFrame([(i, r.choice(few)) for i in range(400)] + [(400, None), (401, []), (402, [0.0] * 4)], "slot long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, vector()) for i in range(30)] + [(30, [0.0, 0.0])], "query_id long, embedding array<double>")
    monkeypatch.setattr(dense, "PART", 20)
    monkeypatch.setattr(dense, "PAIRS", 3000)
    got = rerank.dense_search(c, q, 7)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    same(got, plain_dense(c, q, 7), "query_id", "slot", "score", "rank")
    odd = c.unionByName(spark.createDataFrame([(500, [float("nan"), 1.0]), (501, [None, 1.0]), (502, [1e200, 1.0])], c.schema))
    asked = q.unionByName(spark.createDataFrame([(40, None), (41, [float("inf"), 1.0])], q.schema))
    same(rerank.dense_search(odd, asked, 405), plain_dense(odd, asked, 405), "query_id", "slot", "score", "rank")


def test_second_list_is_met_by_ids(spark):
    assert "NestedLoop" not in plan(registered.two_lists(spark, "/root/testdata/sf0.001")[1])


def test_norms_of_a_list_need_no_loop(spark):
    assert "NestedLoop" not in plan(registered.minmax_norm(spark, "/root/testdata/sf0.001"))


def test_short_patterns_are_looked_up_in_words(spark, monkeypatch):
    from marlweave.operators import containment

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcé한\U0001f600") for _ in range(r.randint(1, n)))
    texts = [(i, r.choice([" ", "\n\t", "  "]).join(word(40) for _ in range(r.randint(0, 9)))) for i in range(80)] + [(90, None), (91, "")]
    patterns = [(i, word(4)) for i in range(60)] + [(100 + i, f"{word(3)} {word(2)}") for i in range(40)] + [(200 + i, t[-20:]) for i, t in texts if t]
    patterns += [(400 + i, t.split()[0][1:30]) for i, t in texts if t] + [(500, "\n\t"), (501, " "), (502, "a "), (503, " a")]
    calls = []
    met = containment._met
    monkeypatch.setattr(containment, "_met", lambda t, p, *a: calls.append(sorted(x["pattern"] for x in p.collect())) or met(t, p, *a))
    got = containment.contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")).collect()
    want = sorted((t, p) for t, x in texts for p, y in patterns if x is not None and y and y in x)
    assert sorted((g["text_id"], g["pattern_id"]) for g in got) == want and len(want) > 200
    # pairs of characters are common: only blanks are looked up by them
    assert all(not p.strip() or len(p.split()) > 2 for c in calls for p in c)


def corpus(spark, rows=200):
    r = random.Random(11)
    word = lambda: r.choice(["tree", "trees", "house", "river", "stone", "cat", "dog", "색상", "규정", "감사규정", "황갈색", "법", "x1", "of", "カナ漢字", "ties", "buses", "TREES", "naïves", "movies"])
    text = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
    texts = [(i, text(3), text(r.choice([2, 5, 30]))) for i in range(rows)]
    c = spark.createDataFrame(texts + [(rows + i, a, b) for i, a, b in texts[:40]], "slot long, title string, text string").repartition(7)
    said = spark.createDataFrame([(r.randrange(rows), f"{text(4)} zz{r.randrange(3)}", i) for i in range(30)], "slot long, query string, seq long")
    q = spark.createDataFrame([(i, text(6) + r.choice([" zz1", "", " nowhere"])) for i in range(40)] + [(90, ""), (91, None)], "query_id int, question string")
    return ranking.texts(c, said), q


def test_best_is_the_top_of_all_scores(spark, monkeypatch):
    docs, q = corpus(spark)
    index = ranking.Index.build(ranking._tokenized(docs))
    monkeypatch.setattr(scoring, "QUESTIONS", 17)
    monkeypatch.setattr(scoring, "BLOCK", 17 * 16)
    monkeypatch.setattr(scoring, "BYTES", 100)
    for fielded, coordinated, recover, multiplicity in ((True, True, True, True), (False, True, False, True), (False, False, True, False)):
        scores = ranking.bm25f(index, q) if fielded else ranking.bm25(index, q, multiplicity=multiplicity)
        want = ranking.top_k(ranking.coordinate(scores, recover) if coordinated else scores, 6)
        for source in (docs, index) if fielded else (docs,):
            got = ranking.best(source, q, 6, fielded=fielded, coordinated=coordinated, recover=recover, multiplicity=multiplicity)
            same(got, want, "query_id", "slot", "score", "rank")
    # pairs of question and chunk are not shuffled; slots that repeat go by the general way
    text = plan(ranking.best(docs, q, 6))
    assert "MapInArrow" in text and "Join" not in text
    twice = docs.unionByName(docs.where("slot < 20"))
    same(ranking.best(twice, q, 6), ranking.top_k(ranking.bm25f(ranking._tokenized(twice), q), 6), "query_id", "slot", "score", "rank")


def test_words_of_a_term(spark):
    from marlweave.functions.text import s_stem

    r = random.Random(3)
    words = sorted({"".join(r.choice("aesiouybt1") for _ in range(r.randint(1, 6))) for _ in range(3000)} | {"ties", "ies", "movies", "eies", "bus", "class", "oes"})
    for row in spark.createDataFrame([(w,) for w in words], "w string").select("w", s_stem(F.col("w")).alias("s")).collect():
        assert scoring.stem(row["w"]) == row["s"] and row["w"] in scoring.forms(row["s"]) or scoring.stem(row["s"]) != row["s"]


def test_long_patterns_are_looked_up_where_a_text_lies(spark, monkeypatch):
    from marlweave.operators import containment

    r = random.Random(4)
    line = lambda n: r.choice([" ", "\n", "\xa0", "  "]).join(r.choice(["ab", "b", "the", "é", "x-y"]) for _ in range(n))
    texts = [(i, line(r.randint(0, 30))) for i in range(60)]
    patterns = [(i, t[r.randint(0, 9) :][: r.randint(9, 25)]) for i, t in texts] + [(90, "the b none")]
    args = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(patterns, "pattern_id int, pattern string")
    want = sorted((t, p) for t, x in texts for p, y in patterns if y and y in x)
    calls, met = [], containment._met
    monkeypatch.setattr(containment, "_met", lambda t, p, *a: calls.append(p.where("inner > 0").count()) or met(t, p, *a))
    assert sorted((g["text_id"], g["pattern_id"]) for g in containment.contained(*args).collect()) == want and len(want) > 60
    assert not any(calls)
    monkeypatch.setattr(containment, "BROADCAST_CHARACTERS", 1)
    assert sorted((g["text_id"], g["pattern_id"]) for g in containment.contained(*args).collect()) == want and any(calls)


def test_pairs_are_counted_in_bounded_parts(spark, monkeypatch):
    want = registered.token_bigrams(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(registered, "PAIRS_OF", 50_000)
    got = registered.token_bigrams(spark, "/root/testdata/sf0.001")
    assert int(plan(got).split("RoundRobinPartitioning(")[1].split(")")[0]) > 4
    same(got, want, "pair", "n")


def test_postings_and_overlays_shuffle_no_postings(spark):
    from marlweave.operators import mutation

    docs = ranking._tokenized(corpus(spark, 60)[0])
    plain = docs.select("slot", F.posexplode(F.array("title_tokens", "body_tokens", "memory_tokens")).alias("f", "t")).select("slot", "f", F.explode("t").alias("term"))
    want = plain.groupBy("slot", "term").agg(*[F.sum((F.col("f") == k).cast("long")).alias(c) for k, c in enumerate(scoring.TIMES)])
    got = ranking.postings(docs)
    same(got, want, "slot", "term", *scoring.TIMES)
    assert "hashpartitioning(slot" not in plan(got.select("term")) and got.dtypes == want.dtypes
    over = mutation.overlay(got, docs.where("slot % 3 = 0").select("slot"), got.where("slot = 3"))
    assert "SortMergeJoin" not in plan(over)
    same(over, want.where("slot % 3 <> 0 OR slot = 3"), "slot", "term", *scoring.TIMES)
    twice = docs.unionByName(docs)
    same(ranking.postings(twice), want.select("slot", "term", *[(2 * F.col(c)).alias(c) for c in scoring.TIMES]), "slot", "term", *scoring.TIMES)
