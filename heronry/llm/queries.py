"""Queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from heronry.llm import clusters, consolidate, history, leaks, neighbours, quality, survivors, together, tokens

QUERIES = {
    "p1_found": survivors.p1_found,
    "p1_survivors": survivors.p1_survivors,
    "p1_trust": survivors.p1_trust,
    "p2_found": consolidate.p2_found,
    "p3_found": neighbours.p3_found,
    "p3_similar": neighbours.p3_similar,
    "p4_found": history.p4_found,
    "p6_found": clusters.p6_found,
    "p6_clusters": clusters.p6_clusters,
    "p7_found": together.p7_found,
    "p7_scores": together.p7_scores,
    "p8_ids": tokens.p8_ids,
    "p9_found": leaks.p9_found,
    "p10_found": quality.p10_found,
    "p10_statistics": quality.p10_statistics,
}

_COUNTS = """
WITH t AS (SELECT DISTINCT file_id, category_id FROM media_tags WHERE file_id IS NOT NULL),
n AS (SELECT count(DISTINCT file_id) AS n FROM t),
one AS (SELECT category_id AS c, count(*) AS k FROM t WHERE category_id IS NOT NULL GROUP BY 1),
two AS (SELECT x.category_id AS a, y.category_id AS b, count(*) AS k FROM t x JOIN t y ON x.file_id = y.file_id AND x.category_id < y.category_id GROUP BY 1, 2)
"""

SQL = {
    "p7_found": _COUNTS + """
SELECT two.a AS category_a, two.b AS category_b FROM two JOIN one p ON p.c = two.a JOIN one q ON q.c = two.b CROSS JOIN n
WHERE two.k >= 5 AND two.k * n.n >= 2 * p.k * q.k""",
    "p7_scores": _COUNTS + """
SELECT two.a AS category_a, two.b AS category_b, two.k AS n_ab, p.k AS n_a, q.k AS n_b, n.n AS n,
       round(two.k * n.n / (p.k::DOUBLE * q.k), 6) AS lift
FROM two JOIN one p ON p.c = two.a JOIN one q ON q.c = two.b CROSS JOIN n""",
}
