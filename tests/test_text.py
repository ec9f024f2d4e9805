"""Text functions against the fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from marlweave.functions import hangul, text


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("statins", "statin"), ("studies", "study"), ("diseases", "disease"), ("cells", "cell"), ("virus", "virus"), ("access", "access"), ("gas", "gas"), ("his", "his"), ("bees", "bee"), ("toes", "toe"), ("eies", "eie"), ("aies", "aie"), ("analysis", "analysi"), ("study", "study")])
def test_stems(spark, word, stem):
    assert one(spark, text.s_stem(F.col("w")), w=word) == stem


def test_tokens(spark):
    assert {"statin", "#담보"} <= set(one(spark, text.tokens("t"), t="담보 한도 statins"))
    assert one(spark, text.tokens("t"), t="東京 ab 会") == ["ab", "東京", "会"]
    assert one(spark, text.query_tokens("t"), t="Will you show me how the jet engines are built?") == ["show", "jet", "engine", "built"]
    assert one(spark, text.query_tokens("t"), t="What is it?") == ["what", "is", "it"]
    got = one(spark, text.query_tokens("t"), t="스키밍이란 무엇인가요?")
    assert "#스키밍" in got and "#무엇" not in got and "#인가" not in got


@pytest.mark.parametrize("word,stem", [("어디인가", "어디"), ("어디인가요", "어디"), ("무엇인가", "무엇"), ("누구입니까", "누구"), ("상황", "상황"), ("인가", "인가"), ("승인가능", "승인가능"), ("부동산", "부동산")])
def test_korean_stems(word, stem):
    assert hangul.stem(word) == stem


def test_korean_stem_keeps_two_characters():
    r = random.Random(1)
    endings = sorted({s for _, g in hangul.suffixes() for s in g})
    for _ in range(2000):
        w = "".join(chr(r.randint(0xAC00, 0xD7A3)) for _ in range(2)) + "".join(r.choice(endings) for _ in range(r.randint(0, 3)))
        s = hangul.stem(w)
        assert len(s) >= 2 and w.startswith(s) and hangul.stem(s) == s


def test_personal(spark):
    assert one(spark, text.is_personal("q"), q="What papers have I've had accepted?")
    assert one(spark, text.is_personal("q"), q="Which projects did we finish?")
    assert not one(spark, text.is_personal("q"), q="What is the capital of France?")


def test_titles(spark):
    def match(q, t):
        row = text.with_title_match(spark.createDataFrame([(q, t)], "q string, t string"), "q", "t", "m").first()["m"]
        return row and (row["affinity"], row["offset"])

    assert match("When Patrick Baudry flew", "Patrick Baudry") == (1.0, 1)
    assert match("Where is Minister Pool", "Minster Pool")[0] == 0.95
    assert match("mercury rises", "Mercury") is None
    assert match("mercury rises", "Mercury (planet)") == (1.0, 0)
    rows = text.with_title_aliases(spark.createDataFrame([("Philip V of Spain",), ("Andrea Carroll (soprano)",), ("Mercury",)], "t string"), "t", "a")
    assert [x["a"] for x in rows.collect()] == [[["philip", "v", "of", "spain"], ["philip", "v"]], [["andrea", "carroll"]], []]


def test_jaccard_and_cited(spark):
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))), z=1) == 1.0
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array(F.lit("b"))), z=1) == 0.0
    got = one(spark, text.cited_nodes(F.array(F.lit("ab → p → cd")), F.lit("[CLASS 'K1' has 2 instances: xx | yy. z]"), F.lit("ab and xx of K1")), z=1)
    assert got == ["K1", "ab", "xx"]
