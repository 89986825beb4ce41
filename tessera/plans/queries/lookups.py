"""Callable lookups answering many ids at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extraction as XO
from tessera.operators import vectors as V
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register


@register("similar_reports", with_views("""
    SELECT k.qid, k.rank, k.id, round(k.sim, 3) AS sim, r.component, left(r.summary, 120) AS summary
    FROM knn6 k JOIN reports r ON k.id = r.id
    WHERE k.qid IN (SELECT doc_id FROM labels)""", "knn6", "reports"))
def q_similar_reports(spark, sf):
    """Six similar reports for every labelled id that has a vector."""
    ids = td.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return V.similar(ids, td.vectors(spark, sf), td.reports(spark, sf), 6)


@register("prior_for_areas")
def q_prior_for_areas(spark, sf):
    """Component prior for every extracted area, via the closest component."""
    areas = XO.validate_replies(td.extraction_replies(spark, sf)).select(F.lower("area").alias("value"))
    return XO.prior_for(areas, td.severity_reports(spark, sf), td.ORDER_PRIORITY_SEVERITY)
