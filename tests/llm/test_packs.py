"""Packs of keys: hot keys, flags, and what is called alike, against a plain count."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlweave.llm import packs

KIND = {"context": "u8", "place": "u4", "copied": "u1"}


@pytest.mark.parametrize("common", [2, 1000])
def test_repeated_keys(spark, common):
    r = random.Random(2)
    rows = []
    for doc in range(200):
        for place in range(r.randint(0, 6)):
            key = r.choice([1, 2, 3, *range(10, 400)]) << 40
            rows.append((doc, key, 7 if key == 2 << 40 else r.randint(1, 2), place, int(doc % 50 == 0)))

    def run(batches):
        pack = packs.Packer(KIND, 6, "copied", common)
        for batch in batches:
            for doc, key, context, place, copied in zip(*(c.to_pylist() for c in batch.columns)):
                tid = doc.to_bytes(4, "big")
                number = pack.text(tid, 5) if pack.fresh(tid) else pack.number[tid]
                pack.add(np.array([key], np.uint64), np.array([number]), np.array([context]), np.array([place]), np.array([copied]))
        yield pack.flush()

    df = spark.createDataFrame(rows, "doc long, key long, context long, place long, copied long").repartition(4, "doc").mapInArrow(run, packs.PACKS).cache()
    name = {x["h"]: int.from_bytes(bytes(x["tid"]), "big") for x in packs.texts(df).collect()}
    got = packs.repeated(df, KIND, "copied", "context").collect()
    count = Counter(x[1] for x in rows)
    want = sorted((d, k, c, p, f) for d, k, c, p, f in rows if count[k] > 1 or f)
    assert sorted((name[x["h"]], x["key"], x["context"], x["place"], x["copied"] % 2) for x in got) == want
    kinds = {}
    for _, k, c, _, _ in rows:
        kinds.setdefault(k, set()).add(c)
    assert all(not x["alike"] or len(kinds[x["key"]]) == 1 for x in got)
    if common == 1000:
        assert all(x["alike"] == (len(kinds[x["key"]]) == 1) for x in got)
    else:
        assert all(not x["alike"] for x in got if x["key"] == 2 << 40)
    assert packs.repeated(df.limit(0), KIND, "copied", "context").count() == 0 and pa.__version__
