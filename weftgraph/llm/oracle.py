"""DuckDB statements for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from weftgraph.llm import licenses

WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, {WORDS} AS w FROM d),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS rep FROM g),
e AS (SELECT doc_id, n, unnest(s) AS gram FROM c WHERE doc_id = rep),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap, a.n AS size_a, b.n AS size_b
      FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT doc_a, doc_b FROM p WHERE overlap::DOUBLE / (size_a + size_b - overlap) >= 0.3),
two AS (SELECT doc_a AS a, doc_b AS b FROM k UNION ALL SELECT doc_b, doc_a FROM k),
reach(a, b) AS (SELECT a, a FROM two UNION SELECT r.a, x.b FROM reach r JOIN two x ON r.b = x.a),
part AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS links FROM two GROUP BY a),
size AS (SELECT rep, count(*) AS m FROM c GROUP BY rep)
SELECT c.doc_id, coalesce(part.low, c.rep) AS class_id, c.rep AS set_id, coalesce(deg.links, 0) AS links
FROM c JOIN size ON size.rep = c.rep LEFT JOIN part ON part.a = c.rep LEFT JOIN deg ON deg.a = c.rep
WHERE size.m > 1 OR deg.links IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3, "op4_license_digests": licenses.oracle()}
