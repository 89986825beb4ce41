"""SQL twins of the test-table adapters, as CTE bodies for the DuckDB oracle.

Each constant is the SQL of one adapter in ``plans.testdata``; oracle queries
prepend the ones they need with ``with_views``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "text_groups": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS master_id,
               count(*) OVER (PARTITION BY text) AS copies
        FROM documents""",
    "reports": """
        SELECT d.doc_id AS id, d.source AS component,
               split_part(d.text, chr(10), 1) AS summary,
               CASE WHEN strpos(d.text, chr(10)) > 0
                    THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS description,
               d.lang,
               CASE WHEN g.copies = 1 THEN 'corpus' WHEN g.doc_id = g.master_id THEN 'master'
                    ELSE 'dup' END AS role
        FROM documents d JOIN text_groups g ON d.doc_id = g.doc_id""",
    "text_pairs": """
        SELECT doc_id AS dup_id, master_id FROM text_groups WHERE doc_id <> master_id""",
    "vectors": """
        SELECT vec_id AS id, embedding, label FROM embeddings""",
    "vector_pairs": """
        SELECT dup_id, master_id FROM (
          SELECT vec_id AS dup_id, min(vec_id) OVER (PARTITION BY label) AS master_id FROM embeddings)
        WHERE dup_id <> master_id""",
    "severity_reports": """
        SELECT o.o_orderkey AS id, c.c_mktsegment AS component, o.o_orderpriority AS severity,
               c.c_name AS summary, o.o_orderdate AS creation_time, o.o_orderstatus AS status
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "trace": """
        SELECT conv_id AS run_id, turn AS step, role AS node, text FROM conversations""",
    "ratings": """
        SELECT doc_id AS id, quality AS rater_a, toxic AS rater_b FROM labels""",
}



def _knn(k: int) -> str:
    """Exact cosine top ``k`` per vector, self excluded, ties by id."""
    return f"""
        SELECT qid, CAST(rn AS INTEGER) AS rank, id, sim FROM (
          SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM (
            SELECT a.vec_id AS qid, b.vec_id AS id,
                   list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
                     / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                        * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))
                     AS sim
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
        WHERE rn <= {k}"""


VIEWS["knn10"] = _knn(10)
VIEWS["knn6"] = _knn(6)
# Label centroids (mean per dimension).
VIEWS["centroids"] = """
        SELECT label, list(x ORDER BY pos) AS centroid FROM (
          SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
            SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
          GROUP BY label, pos)
        GROUP BY label"""
# Per-point exact Euclidean silhouette over the label clusters.
VIEWS["silhouette_points"] = """
        WITH pd AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other,
                           list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
                    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        m AS (SELECT id, own, other, avg(d) AS md FROM pd GROUP BY ALL),
        ab AS (SELECT id, own, max(CASE WHEN own = other THEN md END) AS a,
                      min(CASE WHEN own <> other THEN md END) AS b FROM m GROUP BY id, own)
        SELECT id, own AS label, a, b,
               CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
        FROM ab"""

# Views that other views read (resolved in this order).
_DEPENDS = {
    "reports": ["text_groups"],
    "text_pairs": ["text_groups"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs ``names`` (and what they read)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return f"WITH {ctes}\n{sql}"
