"""A remote SPARQL 1.1 graph as edge and node tables; terms are escaped, addresses checked."""

from __future__ import annotations

import base64
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ADDRESS = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$")
W3 = "http://www.w3.org"
SKIPPED = (W3 + "/1999/02/22-rdf-syntax-ns#type", W3 + "/2000/01/rdf-schema#label")


def iri(x: str) -> str:
    if not ADDRESS.match(x):
        raise ValueError(f"not an address: {x!r}")
    return f"<{x}>"


def literal(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def graph_clause(graph: str | None, body: str) -> str:
    return f"GRAPH {iri(graph)} {{ {body} }}" if graph else body


def label_query(terms: list[str], graph: str | None, limit: int) -> str:
    """Labels that hold any of the first eight terms of two characters or more; whole-stem marks match nothing and are left out."""
    use = [t for t in terms if len(t) >= 2 and not t.startswith("#")][:8]
    test = " || ".join(f"CONTAINS(LCASE(STR(?l)), {literal(t)})" for t in use) or "false"
    return f"SELECT ?n ?l WHERE {{ {graph_clause(graph, '?n <' + SKIPPED[1] + '> ?l')} FILTER({test}) }} LIMIT {int(limit)}"


def edge_query(node: str, graph: str | None, limit: int) -> str:
    skip = ", ".join(f"<{p}>" for p in SKIPPED)
    n = iri(node)
    return f"SELECT ?s ?p ?o WHERE {{ {graph_clause(graph, f'{{ ?s ?p ?o . FILTER(?s = {n}) }} UNION {{ ?s ?p ?o . FILTER(?o = {n}) }}')} FILTER(?p NOT IN ({skip})) }} LIMIT {int(limit)}"


def post(url: str, query: str, user: str | None = None, password: str | None = None, timeout: int = 30) -> list[dict[str, str]]:
    """Bindings of a query; credentials are sent only if both are given."""
    request = urllib.request.Request(url, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json"})
    if user and password:
        both = ":".join((user, password)).encode()
        request.add_header("Authorization", "Basic " + base64.b64encode(both).decode())
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        rows = json.load(answer)["results"]["bindings"]
    return [{k: v["value"] for k, v in row.items()} for row in rows]


class RemoteGraph:
    """Edges around given nodes, and label hits, as DataFrames; ``send`` is replaceable."""

    def __init__(self, spark: SparkSession, url: str, graph: str | None = None, user: str | None = None, password: str | None = None, send: Callable[..., list[dict[str, str]]] = post) -> None:
        self.spark, self.url, self.graph, self.user, self.password, self.send = spark, url, graph, user, password, send

    def _rows(self, query: str) -> list[dict[str, str]]:
        return self.send(self.url, query, self.user, self.password)

    def edges(self, nodes: list[str], limit: int = 100) -> DataFrame:
        rows = [(r["s"], r["p"], r["o"]) for n in nodes for r in self._rows(edge_query(n, self.graph, limit))]
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, s string, p string, o string")

    def labels(self, terms: list[str], limit: int = 30) -> DataFrame:
        """(node_id, label, score): the number of terms in the label, at least 1."""
        rows = self._rows(label_query(terms, self.graph, limit))
        scored = [(r["n"], r["l"], float(sum(t in r["l"].lower() for t in terms) or 1)) for r in rows]
        return self.spark.createDataFrame(sorted(scored, key=lambda r: -r[2]), "node_id string, label string, score double")
