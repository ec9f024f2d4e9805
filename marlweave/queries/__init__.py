"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graphs, lexical, more, state

_ALL = {**lexical.QUERIES, **graphs.QUERIES, **state.QUERIES, **more.QUERIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: fn for name, (fn, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: text for name, (_, text) in _ALL.items() if text}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["retrieve_topk"](spark, sf_dir)
