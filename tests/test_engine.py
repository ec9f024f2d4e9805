"""Ranking, graph, fusion, memory and changes on the small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlweave.config import Config
from marlweave.operators import fusion, graph, lexical, linking, memory, mutation, rerank
from marlweave.plans.engine import Engine
from marlweave.sources import bundle, readers, sparql
from marlweave.streaming import changes


def chunks(spark, *rows):
    return readers.chunks_of(spark, rows)


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_bm25_against_the_formula(spark):
    r = random.Random(3)
    texts = [" ".join(f"term{r.randint(0, 15)}" for _ in range(r.randint(1, 12))) for _ in range(40)]
    questions = [" ".join(f"term{r.randint(0, 15)}" for _ in range(3)) for _ in range(8)]
    docs = lexical.tokenized(chunks(spark, *[{"id": str(i), "text": t} for i, t in enumerate(texts)]))
    got = {(x["query_id"], x["slot"]): x["score"] for x in lexical.bm25(docs, ask(spark, *questions)).collect()}
    split = [t.split() for t in texts]
    avg = sum(map(len, split)) / len(split)
    df = Counter(w for s in split for w in set(s))
    want = {}
    for q, question in enumerate(questions):
        for i, s in enumerate(split):
            score = 0.0
            for w in question.split():
                f = s.count(w)
                if f:
                    idf = math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) ** 1.2
                    score += idf * 2.5 * f / (f + 1.5 * (0.25 + 0.75 * len(s) / avg))
            if score:
                want[q, i] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_ties_limits_and_multiplicity(spark):
    c = chunks(spark, ("a", "same text"), ("b", "same text"), ("c", "same text"))
    hits = lexical.top_k(lexical.bm25(lexical.tokenized(c), ask(spark, "same")), 2).orderBy("rank").collect()
    assert [x["slot"] for x in hits] == [0, 1]
    with pytest.raises(ValueError):
        lexical.top_k(hits, -1)
    c = chunks(spark, ("a", "alpha beta"), ("b", "beta beta"))
    twice = lexical.bm25(lexical.tokenized(c), ask(spark, "alpha alpha beta")).where("slot = 0").first()["score"]
    once = lexical.bm25(lexical.tokenized(c), ask(spark, "alpha alpha beta"), multiplicity=False).where("slot = 0").first()["score"]
    assert twice > once


def test_title_beats_body_and_phrase_order(spark):
    c = chunks(spark, {"id": "t", "title": "drug approval", "text": "x"}, {"id": "b", "text": "notes on drug and then approval of many other things"})
    top = rerank.lexical_search(c, ask(spark, "drug approval"), 5).where("rank = 1").first()
    assert top["slot"] == 0


def test_coordination(spark):
    rows = spark.createDataFrame([(0, 0, 8.0, True), (0, 1, 3.0, True), (0, 2, 7.0, False), (0, 3, 2.0, False)], "query_id long, slot long, score double, complete boolean")
    kept = {x["slot"] for x in lexical.coordinate(rows).collect()}
    assert kept == {0, 1, 2}
    low = rows.withColumn("score", F.when(F.col("slot") == 2, 2.5).otherwise(F.col("score")))
    assert {x["slot"] for x in lexical.coordinate(low).collect()} == {0, 1}
    assert {x["slot"] for x in lexical.coordinate(rows, recover=False).collect()} == {0, 1}


def test_korean_fallback(spark):
    c = chunks(spark, ("x", "황갈색입니다."), ("y", "세 가지 색상을 고르세요"), ("z", "무관한 문장"))
    hits = rerank.lexical_search(c, ask(spark, "색", "nothing"), 5, fielded=False).collect()
    assert {x["slot"] for x in hits} == {0, 1} and {x["query_id"] for x in hits} == {0}


def toy(spark):
    nodes = readers.nodes_of(spark, [("c_reg", "규정", "class"), ("n_audit", "감사규정"), ("n_race76", "경마시행규정 제76조"), ("n_info", "정보화업무처리규정"), ("n_illegal", "불법도박")])
    edges = readers.edges_of(spark, [("n_audit", "instanceOf", "c_reg"), ("n_race76", "instanceOf", "c_reg"), ("n_info", "instanceOf", "c_reg"), ("n_illegal", "관련규정", "n_race76")])
    c = chunks(spark, ("ch1", "불법도박은 한국마사회법 제48조에 따라 단속되며" + " 경마시행규정 제76조가 적용된다.", ["n_illegal", "n_race76"]), ("ch2", "감사규정은 내부 감사 절차를 규정한다.", ["n_audit"]))
    return Engine(c, nodes, edges, fielded=False)


def test_search_end_to_end(spark):
    x = toy(spark).search(ask(spark, "불법도박 관련 규정")).first()
    assert "규정" in x["class_seed"] and any("관련규정" in r for r in x["relations"])
    assert x["chunks"][0] == "ch1"
    e = toy(spark)
    assert graph.search_labels(e.nodes, ask(spark, "감사")).where("rank = 1").first()["label"] == "감사규정"
    assert graph.class_counts(e.edges).first()["n"] == 3 and graph.class_instances(e.edges, e.nodes).count() == 3
    near = graph.neighbors(e.edges, e.nodes, spark.createDataFrame([("n_race76",)], "node string")).collect()
    assert {x["p"] for x in near} == {"instanceOf", "관련규정"}


def test_companions_and_directions(spark):
    c = chunks(spark, {"id": "A", "title": "위반 신고", "text": "위반 신고 의무"}, {"id": "B", "title": "벌칙", "text": "과태료"}, {"id": "C", "text": "무관"})
    nodes, edges = readers.nodes_of(spark, [("C", "기타 규정"), ("B", "벌칙 조항"), ("A", "위반 신고")]), readers.edges_of(spark, [("A", "references", "B")])
    q = ask(spark, "신고 의무 위반")
    with_ = {x["chunk_id"] for x in Engine(c, nodes, edges).retrieve(q).collect()}
    without = {x["chunk_id"] for x in Engine(c, nodes, edges, config=Config(graph_fusion=False)).retrieve(q).collect()}
    assert {"A", "B"} <= with_ and "B" not in without
    edges = readers.edges_of(spark, [("A", "p", "B"), ("C", "p", "A"), ("A", "p", "A")])
    seed = spark.createDataFrame([("A",)], "node string")
    ids = lambda d: [x["other"] for x in graph.neighbor_ids(edges, seed, direction=d).orderBy("pos").collect()]
    assert sorted(ids("both")) == ["B", "C"] and ids("in") == ["C"] and ids("out") == ["B"]
    with pytest.raises(ValueError):
        graph.neighbor_ids(edges, seed, direction="up")


def test_derive_nodes_and_links(spark):
    n = {x["node_id"]: x["kind"] for x in graph.derive_nodes(readers.edges_of(spark, [("a", "instanceOf", "규정")])).collect()}
    assert n == {"a": "instance", "규정": "class"}
    c = chunks(spark, {"id": "painter", "title": "Lena Marsh", "text": "A painter."}, {"id": "prize", "title": "Silverbrush", "text": "Given to Lena Marsh in 2010."}, {"id": "one", "title": "Shared Name", "text": "x"}, {"id": "two", "title": "Shared Name", "text": "Shared Name"})
    assert [tuple(x) for x in linking.title_links(c).collect()] == [("prize", "references", "painter")]


def test_cut_and_mmr(spark):
    row = lambda *s: spark.createDataFrame([(0, i + 1, float(x)) for i, x in enumerate(s)], "query_id long, rank int, score double")
    assert fusion.dynamic_cut(row(1.0, 0.9, 0.2, 0.1), 0.55, 1, 10).count() == 2
    assert fusion.dynamic_cut(row(1.0, 0.1), 0.9, 2, 10).count() == 2
    c = spark.createDataFrame([(0, 1, 1.0, "the cat sat on mats"), (0, 2, 0.96, "the cat sat on mat"), (0, 3, 0.7, "stocks fell today")], "query_id long, rank int, score double, text string")
    assert {x["rank"] for x in fusion.mmr(c, 0.6, 2).collect()} == {1, 3}
    rel = spark.createDataFrame([(0, "a → p → zebra", 0), (0, "b → p → tax law", 1), (0, "a → p → zebra", 2)], "query_id long, relation string, pos long")
    got = [x["relation"] for x in fusion.rank_relations(rel, ask(spark, "tax law")).orderBy("rank").collect()]
    assert got == ["b → p → tax law", "a → p → zebra"]


def test_memory_lifts_and_content_rarity_stays(spark):
    c = chunks(spark, ("trial", "임상 보고서"), ("weather", "기상 기록"))
    q = ask(spark, "스타틴 콜레스테롤 효과")
    said = spark.createDataFrame([(0, "스타틴이 콜레스테롤을 낮추나요", 0)], "slot long, query string, seq long")
    cold, warm = lexical.tokenized(c), lexical.tokenized(c, said)
    assert lexical.top_k(lexical.bm25f(cold, q), 5).count() == 0
    assert lexical.top_k(lexical.bm25f(warm, q), 5).first()["slot"] == 0
    a, b = (sorted(map(tuple, lexical.term_stats(lexical.postings(d)).where("df > 0").select("term", "df").collect())) for d in (cold, warm))
    assert a == b
    m = memory.remember(spark.createDataFrame([], "chunk_id string, query string, seq long"), spark.createDataFrame([("x", " a ", 1), ("x", "a", 2), ("x", " ", 3), ("y", "b", 4)], "chunk_id string, query string, seq long"))
    assert sorted(map(tuple, m.collect())) == [("x", "a", 1), ("y", "b", 4)]


def test_changes_equal_a_rebuild(spark):
    c = chunks(spark, ("a", "alpha"), ("b", "beta beta"), ("c", "gamma delta")).select("chunk_id", "slot", "title", "text")
    batch = spark.createDataFrame([("b", "", "beta"), ("d", "", "alpha new"), ("a", "", "alpha")], "chunk_id string, title string, text string")
    assert {x["chunk_id"]: x["change"] for x in mutation.compare(c, batch).collect()} == {"a": "unchanged", "b": "updated", "d": "inserted"}
    new = mutation.upsert(c, batch, 3)
    assert {x["chunk_id"]: x["slot"] for x in new.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    changed = new.where("chunk_id IN ('b', 'd')")
    over = mutation.overlay(lexical.postings(lexical.tokenized(c)), changed.select("slot"), lexical.postings(lexical.tokenized(changed)))
    whole = lexical.postings(lexical.tokenized(new))
    assert sorted(map(tuple, over.collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(ValueError):
        mutation.validate(batch.union(batch))


def test_stream_of_changes(spark, tmp_path):
    log = spark.createDataFrame([(0, "upsert", "a", "t", "one"), (1, "upsert", "b", "t", "two"), (2, "delete", "a", None, None), (3, "upsert", "b", "t", "three")], changes.LOG)
    store = changes.ChunkStore(spark, str(tmp_path / "store"))
    for i in range(2):
        log.where(F.col("op_id").between(2 * i, 2 * i + 1)).write.mode("append").parquet(str(tmp_path / "log"))
        store.follow(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "check")).awaitTermination()
    assert [(x["chunk_id"], x["text"]) for x in store.current.collect()] == [("b", "three")] and store.revision == 2
    store.apply(log)
    assert store.revision == 2


def test_sources_and_bundle(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject,predicate,object\na,instanceOf,K\nb,instanceOf,\n")
    (tmp_path / "c.csv").write_text("id,text,entities\nx,hello,a||b\n")
    (tmp_path / "c.jsonl").write_text('{"id": "x", "text": "hi"}\n\n{"id": "y", "title": "T", "entities": ["e"]}\n')
    assert [(x["s"], x["o"]) for x in readers.read_edges_csv(spark, str(tmp_path / "t.csv")).collect()] == [("a", "K")]
    assert readers.read_chunks_csv(spark, str(tmp_path / "c.csv")).first()["entities"] == ["a", "b"]
    assert readers.read_chunks_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 2 and readers.read_chunks_jsonl(spark, None).count() == 0
    e = toy(spark)
    at = f"file://{tmp_path}/index"
    bundle.save(e, at, 3)
    bundle.save(e, at, 4)
    again = bundle.load(spark, at)
    assert again.chunks.count() == 2 and bundle.manifest(spark, at)["revision"] == 4 and again.config == e.config
    order = spark.createDataFrame([(0, "ch2"), (1, "missing"), (2, "ch1"), (3, "ch2")], "pos long, chunk_id string")
    assert [x["chunk_id"] for x in lexical.fetch(again.chunks, order).collect()] == ["ch2", "ch1", "ch2"]


def test_remote_graph_queries_are_escaped(spark):
    sent = []
    g = sparql.RemoteGraph(spark, "http://x", "http://g/1", send=lambda url, q, *a: sent.append(q) or [{"n": "http://n", "l": "Tax Law"}])
    assert g.labels(["tax", "law", 'a"b', "#x"]).first()["score"] == 2.0
    assert '\\"' in sent[0] and "#x" not in sent[0]
    with pytest.raises(ValueError):
        sparql.edge_query("bad> . ?x", None, 5)
