"""DuckDB SQL that gives the same rows as the text queries, where SQL can express them."""

from __future__ import annotations

#: The words of kernel.py as a RE2 class over lower-cased text.
WORD = r"[0-9A-Za-zªµºÀ-ÖØ-öø-῿\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"

#: Pairs of documents by their sets of word 2-grams, and by recursion the least id that links lead to.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o / (x.n + y.n - o) >= 0.6),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
