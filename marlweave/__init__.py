"""Fused retrieval over texts and a knowledge graph, and preparation of training corpora, on Spark."""

from importlib import import_module

#: Public names and where they are; a module is imported when its name is first used.
_WHERE = {
    "Config": "config", "DEFAULT": "config",
    "Engine": "plans.engine", "TableGraph": "plans.engine", "embed": "plans.engine", "generate": "plans.engine",
    "build": "plans.build", "from_edges": "plans.build", "from_jsonl": "plans.build", "from_csv": "plans.build",
    "Store": "plans.store", "Vault": "plans.vault",
    "GraphStore": "protocols", "VectorStore": "protocols", "MutableVectorStore": "protocols", "LLM": "protocols",
    "read_chunks_jsonl": "sources.readers", "read_edges_jsonl": "sources.readers", "read_nodes_jsonl": "sources.readers",
    "read_chunks_csv": "sources.readers", "read_edges_csv": "sources.readers",
    "chunks_of": "sources.readers", "edges_of": "sources.readers", "nodes_of": "sources.readers",
    "save": "sources.bundle", "load": "sources.bundle", "RemoteGraph": "sources.sparql",
    "derive_nodes": "operators.graph", "title_links": "operators.linking", "dynamic_cut": "operators.fusion", "mmr": "operators.fusion", "rank_relations": "operators.fusion",
    "per_query": "operators.metrics", "ChunkStore": "streaming.changes", "windowed_counts": "streaming.changes",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
