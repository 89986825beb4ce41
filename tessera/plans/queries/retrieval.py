"""Retrieval queries: label pairs, exact k-nearest join, hit@k / MRR."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register


@register("retrieval_metrics", with_views("""
    SELECT count(*) AS n_pairs,
           round(avg(CASE WHEN k.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1,
           round(avg(CASE WHEN k.rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
           round(avg(CASE WHEN k.rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10,
           round(avg(coalesce(1.0 / k.rank, 0.0)), 6) AS mrr
    FROM vector_pairs p LEFT JOIN knn10 k ON k.qid = p.dup_id AND k.id = p.master_id
    """, "vector_pairs", "knn10"))
def q_retrieval_metrics(spark, sf):
    """hit@1/5/10 and MRR@10 of label-derived pairs over the vector table."""
    _, m = R.evaluate_retrieval(td.vector_pairs(spark, sf), td.vectors(spark, sf), k=10)
    return m.select("n_pairs", *[r6(F.col(c)).alias(c) for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")])


@register("knn_join", with_views("SELECT qid, rank, id, round(sim, 6) AS sim FROM knn10", "knn10"))
def q_knn_join(spark, sf):
    """Exact cosine top 10 per vector, self excluded."""
    v = td.vectors(spark, sf)
    return V.knn_join(v, v, k=10).select("qid", "rank", "id", r6(F.col("sim")).alias("sim"))


@register("valid_pairs", with_views("""
    SELECT dup_id, master_id FROM text_pairs
    WHERE dup_id IN (SELECT vec_id FROM embeddings) AND master_id IN (SELECT vec_id FROM embeddings)
    """, "text_pairs"))
def q_valid_pairs(spark, sf):
    """Text-copy pairs with both sides in the vector table."""
    return R.valid_pairs(td.text_pairs(spark, sf), td.vectors(spark, sf))


@register("vector_pairs", with_views("SELECT dup_id, master_id FROM vector_pairs", "vector_pairs"))
def q_vector_pairs(spark, sf):
    """Label-derived duplicate pairs (lowest id of each label as master)."""
    return td.vector_pairs(spark, sf)


@register("text_pairs", with_views("SELECT dup_id, master_id FROM text_pairs", "text_pairs"))
def q_text_pairs(spark, sf):
    """Exact-copy pairs of documents (later copy -> lowest doc_id)."""
    return td.text_pairs(spark, sf)
