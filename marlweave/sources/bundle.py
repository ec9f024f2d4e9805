"""Saved engines: Parquet tables with their index, published by a manifest."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators.lexical import Index
from ..plans.engine import Engine
from . import manifest as manifests

FORMAT = 2
TABLES = ("chunks", "nodes", "edges", "memory")
INDEX = ("postings", "lengths", "stats", "terms")


def save(engine: Engine, path: str, revision: int = 0, next_slot: int | None = None, index: bool = True) -> None:
    """Writes all tables as a new version under ``path``, and with ``index`` those of the inverted index.

    Readers see the version before until the new manifest is there, so a failure at any point leaves what was
    there. The version before stays for who has it open; older ones are removed.
    """
    spark = engine.chunks.sparkSession
    before = manifests.latest(spark, path)
    data = f"{path}/data-{uuid.uuid4().hex}"
    try:
        for name in TABLES:
            df: DataFrame | None = getattr(engine, name)
            if df is not None:
                df.write.parquet(f"{data}/{name}")
        if index:
            built = engine.index()
            for name in INDEX:
                getattr(built, name).write.parquet(f"{data}/{name}")
        highest = engine.chunks.agg({"slot": "max"}).first()[0]
        slot = next_slot if next_slot is not None else 0 if highest is None else highest + 1
        about = {"format": FORMAT, "revision": revision, "next_slot": slot, "fielded": engine.fielded, "tables": [n for n in TABLES if getattr(engine, n) is not None], "index": index, "config": asdict(engine.config), "data": data, "before": before[1]["data"] if before else None}
        manifests.commit(spark, path, before[0] + 1 if before else 0, about)
    except Exception:
        manifests.remove(spark, data)
        raise
    if before and before[1].get("before"):
        manifests.remove(spark, before[1]["before"])


def manifest(spark: SparkSession, path: str) -> dict:
    found = manifests.latest(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if found[1].get("format") != FORMAT:
        raise ValueError(f"unknown format {found[1].get('format')!r}")
    return found[1]


def load(spark: SparkSession, path: str) -> Engine:
    """The engine of the newest version; its index, if saved, is read and not built again."""
    about = manifest(spark, path)
    tables = {n: spark.read.parquet(f"{about['data']}/{n}") if n in about["tables"] else None for n in TABLES}
    engine = Engine(**tables, config=Config(**about["config"]), fielded=about["fielded"])
    if about["index"]:
        engine.built["chunks"] = Index(**{n: spark.read.parquet(f"{about['data']}/{n}") for n in INDEX})
    return engine
