"""Pieces of the comparison SQL that several queries share."""

from __future__ import annotations

from ..functions.text import PERSONAL, STOPWORDS

STEM = """CASE WHEN length(w) > 3 AND right(w, 1) = 's' THEN
  CASE WHEN right(w, 3) = 'ies' AND right(w, 4) NOT IN ('eies', 'aies') THEN left(w, length(w) - 3) || 'y'
       WHEN right(w, 2) = 'es' AND right(w, 3) NOT IN ('aes', 'ees', 'oes') THEN left(w, length(w) - 1)
       WHEN right(w, 2) NOT IN ('us', 'ss') THEN left(w, length(w) - 1) ELSE w END ELSE w END"""


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: {STEM})"


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def qtok(x: str) -> str:
    kept = f"list_filter({tok(x)}, lambda t: NOT list_contains({STOP}, t))"
    return f"CASE WHEN len({kept}) = 0 THEN {tok(x)} ELSE {kept} END"


def pairs(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


PERSONAL_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in PERSONAL) + "]"
DOCS = f"docs AS (SELECT doc_id AS slot, substr(text, 1, 80) AS title, text, {tok('substr(text, 1, 80)')} AS t, {tok('text')} AS b FROM documents WHERE text IS NOT NULL AND text <> '')"
QUESTIONS = f"qs AS (SELECT item_id AS query_id, text AS question, {qtok('text')} AS q FROM benchmark)"
TERMS = "terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(q) AS term FROM qs) GROUP BY ALL)"
POSTINGS = "post AS (SELECT slot, term, sum(f) AS tf_title, sum(1 - f) AS tf_body FROM (SELECT slot, unnest(t) AS term, 1 AS f FROM docs UNION ALL SELECT slot, unnest(b) AS term, 0 AS f FROM docs) GROUP BY ALL)"
STATS = "stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_t, avg(len(b)) AS avg_b FROM docs)"
BODY = "body AS (SELECT slot, term, count(*) AS tf FROM (SELECT slot, unnest(b) AS term FROM docs) GROUP BY ALL)"


def idf(df: str, power: float = 1.2) -> str:
    return f"pow(ln(1.0 + (n - {df} + 0.5) / ({df} + 0.5)), {power})"


def bm25(times: str = "qtf", power: float = 1.2) -> str:
    """CTEs that end in scores(query_id, slot, score)."""
    return f"""{DOCS}, {QUESTIONS}, {TERMS}, {STATS}, {BODY},
df AS (SELECT term, count(*) AS df FROM body GROUP BY term),
scores AS (SELECT query_id, slot, round(sum({times} * {idf('df', power)} * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * greatest(len(b), 1) / avg_b))), 9) AS score
  FROM terms JOIN body USING (term) JOIN df USING (term) JOIN docs USING (slot) CROSS JOIN stats GROUP BY ALL)"""


BM25F = f"""{DOCS}, {QUESTIONS}, {TERMS}, {STATS}, {POSTINGS},
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (SELECT query_id, slot, {idf('df')} AS w, 4.0 * tf_title / (0.25 + 0.75 * greatest(len(t), 1) / avg_t) + tf_body / (0.25 + 0.75 * greatest(len(b), 1) / avg_b) AS tf
  FROM terms JOIN post USING (term) JOIN df USING (term) JOIN docs USING (slot) CROSS JOIN stats),
scores AS (SELECT query_id, slot, round(sum(w * tf * 2.5 / (1.5 + tf)), 9) AS score FROM hits GROUP BY ALL)"""


def top(source: str, k: int, name: str = "pool", tie: str = "slot") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM {source} WHERE score > 0) WHERE rank <= {k})"


TRADE = """edges AS (
  SELECT CAST(0 AS BIGINT) * 1000000000 + p_partkey AS pos, 'p:' || p_partkey AS s, 'instanceOf' AS p, 't:' || p_type AS o FROM part
  UNION ALL SELECT CAST(1 AS BIGINT) * 1000000000 + c_custkey, 'c:' || c_custkey, 'instanceOf', 'm:' || c_mktsegment FROM customer
  UNION ALL SELECT CAST(2 AS BIGINT) * 1000000000 + c_custkey, 'c:' || c_custkey, 'locatedIn', 'n:' || c_nationkey FROM customer
  UNION ALL SELECT CAST(3 AS BIGINT) * 1000000000 + s_suppkey, 's:' || s_suppkey, 'locatedIn', 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT CAST(4 AS BIGINT) * 1000000000 + n_nationkey, 'n:' || n_nationkey, 'partOf', 'r:' || n_regionkey FROM nation
  UNION ALL SELECT CAST(5 AS BIGINT) * 1000000000 + o_orderkey, 'o:' || o_orderkey, 'placedBy', 'c:' || o_custkey FROM orders),
labels AS (SELECT 'p:' || p_partkey AS node_id, p_name AS label FROM part UNION ALL SELECT 'c:' || c_custkey, c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region),
ends AS (SELECT 2 * pos AS pos, s AS node_id, false AS c FROM edges UNION ALL SELECT 2 * pos + 1, o, p = 'instanceOf' FROM edges),
nodes AS (SELECT e.node_id, coalesce(any_value(label), e.node_id) AS label, CASE WHEN bool_or(c) THEN 'class' ELSE 'instance' END AS kind, min(pos) AS pos
  FROM ends e LEFT JOIN labels l ON l.node_id = e.node_id GROUP BY e.node_id)"""
QRELS = "qrels AS (SELECT item_id AS query_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
