"""Schemas of the engine's tables."""

NODES = "node_id string, label string, kind string, pos long"
EDGES = "pos long, s string, p string, o string"
CHUNKS = "chunk_id string, slot long, title string, text string, entities array<string>, embedding array<double>, meta string"
QUERIES = "query_id long, question string"
MEMORY = "chunk_id string, query string, seq long"
