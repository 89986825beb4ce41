"""Rater-agreement queries: kappa, confusion, usable labels, hold-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import agreement as AG
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register


_KAPPA_SQL = """
    WITH c AS (SELECT rater_a, rater_b, count(*) AS n FROM ratings
               WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL GROUP BY ALL),
    t AS (SELECT sum(n) AS total, sum(CASE WHEN rater_a = rater_b THEN n ELSE 0 END) AS agree FROM c),
    ma AS (SELECT rater_a AS v, sum(n) AS na FROM c GROUP BY 1),
    mb AS (SELECT rater_b AS v, sum(n) AS nb FROM c GROUP BY 1),
    m AS (SELECT sum(coalesce(na, 0) * coalesce(nb, 0)) AS pe_num FROM ma FULL JOIN mb USING (v))
    SELECT CAST(coalesce(total, 0) AS BIGINT) AS n, round(agree::DOUBLE / total, 6) AS po,
           round(coalesce(pe_num, 0)::DOUBLE / (total::DOUBLE * total), 6) AS pe,
           round(CASE WHEN total > 0 AND coalesce(pe_num, 0)::DOUBLE / (total::DOUBLE * total) < 1
                 THEN (agree::DOUBLE / total - coalesce(pe_num, 0)::DOUBLE / (total::DOUBLE * total))
                      / (1 - coalesce(pe_num, 0)::DOUBLE / (total::DOUBLE * total)) END, 6) AS kappa
    FROM t, m"""


@register("cohen_kappa", with_views(_KAPPA_SQL.replace("WITH c AS", ", c AS", 1), "ratings"))
def q_cohen_kappa(spark, sf):
    """Cohen's kappa between the two label columns."""
    k = AG.cohen_kappa(td.ratings(spark, sf), "rater_a", "rater_b")
    return k.select("n", *[r6(F.col(c)).alias(c) for c in ("po", "pe", "kappa")])


@register("confusion", with_views("""
    SELECT g.a AS rater_a, g.b AS rater_b, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM (SELECT a, b FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)) g
    LEFT JOIN (SELECT rater_a, rater_b, count(*) AS n FROM ratings GROUP BY ALL) c
      ON c.rater_a = g.a AND c.rater_b = g.b""", "ratings"))
def q_confusion(spark, sf):
    """2x2 confusion matrix with zeros kept."""
    return AG.confusion(td.ratings(spark, sf), "rater_a", "rater_b", (0, 1))


@register("rating_summary", with_views("""
    SELECT u.n_used, round(u.ra, 6) AS rater_a_positive_rate, round(u.rb, 6) AS rater_b_positive_rate,
           u.pa AS rater_a_positive, u.pb AS rater_b_positive, t.n_total, t.n_total - u.n_used AS n_held_out
    FROM (SELECT count(*) AS n_used, avg(rater_a::DOUBLE) AS ra, avg(rater_b::DOUBLE) AS rb,
                 CAST(sum(rater_a) AS BIGINT) AS pa, CAST(sum(rater_b) AS BIGINT) AS pb
          FROM ratings WHERE id NOT IN (SELECT id FROM reports WHERE role = 'master')) u,
         (SELECT count(*) AS n_total FROM ratings) t""", "ratings", "reports"))
def q_rating_summary(spark, sf):
    """Positive rates with master documents held out as anchors."""
    held = td.reports(spark, sf, with_role=True).filter(F.col("role") == "master").select("id")
    s = AG.rating_summary(td.ratings(spark, sf), "rater_a", "rater_b", held)
    return s.select("n_used", r6(F.col("rater_a_positive_rate")).alias("rater_a_positive_rate"),
                    r6(F.col("rater_b_positive_rate")).alias("rater_b_positive_rate"),
                    "rater_a_positive", "rater_b_positive", "n_total", "n_held_out")


@register("hold_out", with_views("""
    SELECT id, rater_a, rater_b FROM ratings
    WHERE id NOT IN (SELECT id FROM reports WHERE role = 'master')""", "ratings", "reports"))
def q_hold_out(spark, sf):
    """Label rows with the held-out anchor ids removed."""
    held = td.reports(spark, sf, with_role=True).filter(F.col("role") == "master").select("id")
    return AG.hold_out(td.ratings(spark, sf), held)


@register("usable_labels", """
    SELECT doc_id AS id, CAST(quality AS INTEGER) AS human_good FROM labels
    WHERE TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE) IN (0, 1)""")
def q_usable_labels(spark, sf):
    """Rows with a 0/1 label after a numeric cast."""
    lab = td.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("human_good"))
    return AG.usable_labels(lab)


@register("has_annotations", """
    SELECT coalesce(max(TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE) IN (0, 1)), false) AS annotated
    FROM labels""")
def q_has_annotations(spark, sf):
    """Does the label table hold at least one 0/1 label?"""
    return AG.has_annotations(td.table(spark, sf, "labels"), "quality")


@register("align_ratings", """
    SELECT a.doc_id AS id, a.quality, b.toxic FROM labels a JOIN labels b ON a.doc_id = b.doc_id""")
def q_align_ratings(spark, sf):
    """Two raters aligned by id."""
    lab = td.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return AG.align_ratings(lab, lab, "quality", "toxic")


@register("binarise_score", """
    SELECT event_id, coalesce(CAST(value >= 5 AS INTEGER), 0) AS good FROM events""")
def q_binarise_score(spark, sf):
    """Scores binarised at threshold 5, unreadable -> 0."""
    e = td.table(spark, sf, "events")
    return e.select("event_id", T.binarise_score(F.col("value"), 5).alias("good"))
