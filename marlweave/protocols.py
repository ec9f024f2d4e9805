"""What stores and models offer, so that others can be put in their place."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class GraphStore(Protocol):
    def search_labels(self, queries: DataFrame, limit: int) -> DataFrame: ...

    def neighbors(self, seeds: DataFrame, hops: int, limit: int) -> DataFrame: ...

    def neighbor_ids(self, seeds: DataFrame, limit: int, direction: str) -> DataFrame: ...

    def class_instances(self, limit: int) -> DataFrame: ...

    def class_counts(self) -> DataFrame: ...

    def get_nodes(self, ids: DataFrame) -> DataFrame: ...


@runtime_checkable
class VectorStore(Protocol):
    def hits(self, queries: DataFrame, limit: int | None = None) -> DataFrame: ...

    def fetch(self, wanted: DataFrame) -> DataFrame: ...


@runtime_checkable
class MutableVectorStore(Protocol):
    def upsert_chunks(self, batch: DataFrame) -> dict: ...

    def delete_chunks(self, ids: Any) -> dict: ...


@runtime_checkable
class LLM(Protocol):
    def generate(self, prompt: str, *, system: str | None = None, timeout: float | None = None) -> str: ...
