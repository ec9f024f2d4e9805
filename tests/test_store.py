"""The mutable store, constructors, the vault, bundles and the change log: restart, overlay against rebuild."""

import pytest
from pyspark.sql import functions as F

import marlweave
from marlweave.operators import lexical
from marlweave.plans import build, engine, store, vault
from marlweave.sources import bundle, manifest, readers
from marlweave.streaming import changes

TEXTS = {"a": "alpha beta", "b": "beta gamma", "c": "gamma delta alpha", "d": "delta", "e": "alpha alpha"}


def corpus(spark, texts=TEXTS):
    chunks = readers.chunks_of(spark, [(k, v) for k, v in texts.items()])
    edges = readers.edges_of(spark, [("a", "references", "b")])
    return chunks, readers.nodes_of(spark, [("a", "alpha"), ("b", "beta")]), edges


def questions(spark):
    return spark.createDataFrame([(1, "alpha"), (2, "beta beta"), (3, "gamma delta"), (4, "missing")], "query_id long, question string")


def hits(e, spark):
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in e.hits(questions(spark)).collect())


def rebuilt(s, spark):
    e = engine.Engine(s.table("chunks"), s.table("nodes"), s.table("edges"), store.slotted(s.table("memory"), s.table("chunks")))
    e.fielded = s.view().fielded
    return hits(e, spark)


def test_changes_equal_a_rebuild_and_survive_restart(spark, tmp_path):
    at = str(tmp_path / "store")
    s = store.Store.create(*corpus(spark), at)
    old = s.view()
    before = hits(old, spark)
    got = s.upsert_chunks(spark.createDataFrame([("b", "beta beta alpha"), ("f", "gamma")], "chunk_id string, text string"))
    assert (got["inserted"], got["updated"], got["unchanged"], got["changed"], got["revision"]) == (1, 1, 0, True, 1)
    assert hits(s.view(), spark) == rebuilt(s, spark) != before
    assert s.upsert_chunks(spark.createDataFrame([("f", "gamma")], "chunk_id string, text string"))["changed"] is False and s.revision == 1
    s.remember("where is omega", ["d", "nowhere"])
    s.remember("where is omega", ["d"])
    assert s.revision == 2 and hits(s.view(), spark) == rebuilt(s, spark)
    got = s.delete_chunks(["a", "zz"])
    assert (got["deleted"], got["missing"]) == (1, 1) and hits(s.view(), spark) == rebuilt(s, spark)
    again = store.Store(spark, at)
    assert again.revision == 3 and hits(again.view(), spark) == hits(s.view(), spark)
    assert again.upsert_chunks(spark.createDataFrame([("g", "new", "Title")], "chunk_id string, text string, title string"))["inserted"] == 1
    assert max(r["slot"] for r in again.table("chunks").collect()) == 6  # slots of deleted chunks are not used again
    with_overlay = hits(again.view(), spark)
    assert again.stats()["touched"] > 0
    again.compact()
    assert hits(again.view(), spark) == with_overlay == rebuilt(again, spark) and again.stats()["touched"] == again.stats()["new_postings"] == 0
    again.forget("where is omega", ["d"])
    assert again.table("memory").count() == 0 and hits(again.view(), spark) == rebuilt(again, spark)
    assert hits(old, spark) == before  # a view keeps its revision
    with pytest.raises(RuntimeError):
        s.compact()  # that revision was published by the other handle
    for bad in ([("x", "1"), ("x", "2")], [("", "1")]):
        with pytest.raises(ValueError):
            again.upsert_chunks(spark.createDataFrame(bad, "chunk_id string, text string"))
    again.close(), again.close()
    with pytest.raises(ValueError):
        again.view()


def test_engine_delegates(spark, tmp_path):
    e = build.build(*(corpus(spark)[k] for k in (1, 2, 0)))
    for call in (lambda: e.remember("q", ["a"]), lambda: e.upsert_chunks(e.chunks), lambda: e.delete_chunks(["a"])):
        with pytest.raises(TypeError):
            call()
    with store.Store.create(*corpus(spark), str(tmp_path / "s")).view() as x:
        assert x.delete_chunks(["a"])["deleted"] == 1
    assert isinstance(e.graph(), marlweave.GraphStore) and isinstance(e, marlweave.VectorStore) and isinstance(e, marlweave.MutableVectorStore)


def test_constructors(spark, tmp_path):
    edges = readers.edges_of(spark, [("x", "instanceOf", "Rule"), ("Andrea Carroll page", "references", "z")])
    chunks = readers.chunks_of(spark, [{"id": "one", "title": "Sonya Yoncheva", "text": "a singer"}, {"id": "two", "title": "Operalia", "text": "won by Sonya Yoncheva"}])
    e = build.from_edges(edges, chunks, auto_link_titles=True)
    assert {r["node_id"]: r["label"] for r in e.nodes.collect()}["one"] == "Sonya Yoncheva"
    assert {r["node_id"]: r["kind"] for r in e.nodes.collect()}["Rule"] == "class"
    assert ("two", "references", "one") in {(r["s"], r["p"], r["o"]) for r in e.edges.collect()} and e.edges.count() == 3
    again = build.build(e.nodes, e.edges, chunks, auto_link_titles=True)
    assert again.edges.count() == 3 and again.nodes.count() == e.nodes.count()  # nothing is derived twice
    (tmp_path / "e.csv").write_text("subject,predicate,object\nx,instanceOf,Rule\ny,instanceOf,Rule\n")
    (tmp_path / "c.jsonl").write_text('{"id": "c1", "text": "hello"}\n')
    (tmp_path / "n.jsonl").write_text('{"id": "x", "label": "The X"}\n{"id": "y"}\n')
    assert build.from_csv(spark, str(tmp_path / "e.csv")).nodes.count() == 3
    e = build.from_jsonl(spark, chunks=str(tmp_path / "c.jsonl"), nodes=str(tmp_path / "n.jsonl"))
    assert {r["label"] for r in e.nodes.collect()} == {"The X", "y"} and not e.fielded
    got = e.graph().get_nodes(spark.createDataFrame([("x",), ("q",)], "node_id string")).collect()
    assert {(r["node_id"], r["label"]) for r in got} == {("x", "The X"), ("q", None)}


def test_bundle_keeps_index_slots_and_last_version(spark, tmp_path):
    at = str(tmp_path / "b")
    e = build.build(*(corpus(spark, {"a": "alpha"})[k] for k in (1, 2, 0)))
    bundle.save(e, at)
    assert bundle.manifest(spark, at)["next_slot"] == 1
    first = bundle.load(spark, at)
    bundle.save(build.build(*(corpus(spark)[k] for k in (1, 2, 0))), at, revision=7)
    second = bundle.load(spark, at)
    assert bundle.manifest(spark, at)["revision"] == 7 and "chunks" in second.built
    assert hits(second, spark) == hits(build.build(*(corpus(spark)[k] for k in (1, 2, 0))), spark)
    assert first.chunks.count() == 1
    with pytest.raises(RuntimeError):
        manifest.commit(spark, at, 1, {})
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, str(tmp_path / "none"))


def test_change_log_resumes(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(list(r), changes.LOG)
    one = changes.ChunkStore(spark, at)
    one.apply(rows((0, "upsert", "a", "A", "x"), (1, "upsert", "b", "", "y")))
    again = changes.ChunkStore(spark, at)
    assert (again.revision, again.next_slot, again.applied) == (1, 2, 1) and again.current.count() == 2
    again.apply(rows((1, "upsert", "b", "", "y"), (2, "upsert", "c", "", "z")))  # the first was applied before
    again.apply(rows((2, "upsert", "c", "", "z")))
    assert again.revision == 2 and {r["chunk_id"]: r["slot"] for r in changes.ChunkStore(spark, at).current.collect()} == {"a": 0, "b": 1, "c": 2}
    again.apply(rows((3, "delete", "nothing", None, None)))
    assert changes.ChunkStore(spark, at).applied == 3 and again.revision == 2


def test_vault(spark, tmp_path):
    at = str(tmp_path / "vault")
    v = vault.Vault(spark, at)
    v.fuse([("alpha", "instanceOf", "Category"), ("zeta", "instanceOf", "Category"), ("alpha", "instanceOf", "Category"), ("alpha", "limit", "5B")], ["zeta and alpha", ("plain", ["Category"], "mine")])
    assert v.stats() == {"facts": 3, "notes": 2, "entities": 4}
    notes = {r["note_id"]: r["entities"] for r in v.table("notes").collect()}
    assert notes == {"n0": ["alpha", "zeta"], "mine": ["Category"]}
    before = {r["label"]: r["value"] for r in v.salience().collect()}
    assert before == {"alpha": 3.0, "Category": 3.0, "zeta": 2.0, "5B": 1.0}
    again = vault.Vault(spark, at)
    q = spark.createDataFrame([(1, "alpha limit")], "query_id long, question string")
    got = again.surface(q, 2).first()
    after = {r["label"]: r["value"] for r in again.salience().collect()}
    assert len(got["evidence_nodes"]) <= 2 and all(after[n] == before.get(n, 0) + 0.5 for n in got["evidence_nodes"])
    assert again.fuse(notes=["third"]).table("notes").where("note_id = 'n2'").count() == 1 and vault.Vault(spark, at).stats()["notes"] == 3


def test_exports():
    assert all(getattr(marlweave, name) for name in marlweave.__all__) and len(marlweave.__all__) >= 30


def test_vocabulary_is_that_of_the_postings(spark):
    chunks = corpus(spark)[0].withColumn("title", F.lit("alpha x"))
    docs = lexical.tokenized(chunks, spark.createDataFrame([(0, "omega beta", 1)], "slot long, query string, seq long"))
    assert sorted(map(tuple, lexical.vocabulary(docs).collect())) == sorted(map(tuple, lexical.term_stats(lexical.postings(docs)).collect()))
