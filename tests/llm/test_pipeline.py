"""The pipeline against its stages restated on one machine."""

import numpy as np

import corpus_pipeline
from marlweave.llm import decontam, packing, secrets


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, now = {x["doc_id"]: x["text"] for x in docs.collect()}, docs
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns, name
        kept.append({x["doc_id"] for x in now.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    assert len(kept[1]) >= 0.97 * len(texts)
    first = {}
    for i in sorted(kept[1]):
        first.setdefault(texts[i], i)
    assert kept[2] <= set(first.values())
    bench = [x["text"] for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert kept[3] <= {i for i in kept[2] if not any(b in texts[i] for b in bench)}
    assert kept[4] == kept[3]
    clean = {x["doc_id"]: x["text"] for x in now.collect()}
    for i, t in clean.items():
        assert not secrets.base_spans(t) and (t == texts[i] or secrets.base_spans(texts[i]) or "[SECRET]" in t)
    encode = packing.encoder(packing.default_tokenizer())
    ids = {}
    for p in corpus_pipeline.run(spark, sf).collect():
        ids.setdefault(p["doc_id"], {})[p["start"]] = np.frombuffer(p["ids"], "<u4")
    assert set(ids) == set(clean)
    for i, t in clean.items():
        assert np.concatenate([ids[i][s] for s in sorted(ids[i])]).tolist() == [*encode(t), 0]
    assert decontam.budget(100, 10, 0.06) == 6


def test_stages_on_odd_tables(spark):
    """Nulls in any column, clashing names, ties, repeated rows, long and empty texts, and empty tables."""
    sf = "/root/testdata/sf0.001"
    words = "the dog and the cat are here with a house by the river of all things small".split()
    base = [" ".join(words[(i + k * k) % len(words)] for k in range(60 + i)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t), "k", "l", "m", 1) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", None, 0, "k", None, None, None), (None, base[3], None, "s", None, None, None, None, None), (5, base[5], "en", "s", 3, "k", "l", "m", 1), (5, base[5], "en", "s", 3, "k", "l", "m", 1)]
    rows += [(200, " ".join(base) * 60, "en", "s", 9, "k", "l", "m", 1), (201, "123 ...", "en", "s", 7, "k", "l", "m", 1), (202, base[7] + " token=abcd1234efgh", "en", "s", 1, "k", "l", "m", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, language string, secrets string, h long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        got = out.collect()
        ids = [r["doc_id"] for r in got]
        if name == "packing":
            assert {100, 101, 200} <= set(ids) and ids.count(5) >= 3
            continue
        assert out.columns == empty.columns == docs.columns, name
        if name == "language":
            assert not {100, 101, 201} & set(ids) and ids.count(5) == 3 and 200 in ids and None in ids
        if name == "near duplicates":
            assert len({100, 101} & set(ids)) == 1 and ids.count(5) <= 1 and None not in ids and {200, 201} <= set(ids)
        if name == "decontamination":
            assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
        if name == "secrets":
            by = {r["doc_id"]: r for r in got}
            assert len(got) == len(rows) and by[100]["text"] is None and by[202]["text"].endswith("token=[SECRET]") and by[202]["n_chars"] == len(by[202]["text"]) and by[200]["n_chars"] == 9
