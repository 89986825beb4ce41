"""Text column-function queries over the report table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import stats as ST
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.plans.sqlparts import s_clean_label, s_compose, s_severity, s_words
from tessera.sources import ingest as IN


@register("compose_text", with_views(f"""
    SELECT id, role, {s_compose('component', 'summary', 'description')} AS text,
           {s_words('description')} AS desc_words
    FROM reports""", "reports"))
def q_compose_text(spark, sf):
    """Report text and description word count over all documents."""
    return ST.with_text(td.reports(spark, sf, with_role=True)).select("id", "role", "text", "desc_words")


@register("clip_text", with_views(f"""
    SELECT id, left(t, 8000) AS text_8000, left(summary, 200) AS summary_200,
           left(summary, 120) AS summary_120, CAST(length(left(description, 1200)) AS INTEGER) AS desc_1200_chars,
           CAST(length(left(description, 4000)) AS INTEGER) AS desc_4000_chars, left(t, 2000) AS judge_2000
    FROM (SELECT *, {s_compose('component', 'summary', 'description')} AS t FROM reports)""", "reports"))
def q_clip_text(spark, sf):
    """Character budgets applied to text, summary and description."""
    r = ST.with_text(td.reports(spark, sf))
    return r.select("id", T.clip("text", 8000).alias("text_8000"), T.clip("summary", 200).alias("summary_200"),
                    T.clip("summary", 120).alias("summary_120"),
                    F.length(T.clip("description", 1200)).alias("desc_1200_chars"),
                    F.length(T.clip("description", 4000)).alias("desc_4000_chars"),
                    T.clip("text", 2000).alias("judge_2000"))


@register("judge_text", with_views("""
    SELECT id, '[' || coalesce(component, '') || '] ' || coalesce(summary, '') || chr(10)
               || coalesce(description, '') AS judge_text
    FROM reports""", "reports"))
def q_judge_text(spark, sf):
    """P10: judge text of every report (whole text)."""
    r = td.reports(spark, sf)
    return r.select("id", T.judge_text("component", "summary", "description").alias("judge_text"))


@register("map_severity", with_views(f"""
    SELECT id, severity, {s_severity('severity', td.ORDER_PRIORITY_SEVERITY)} AS level
    FROM severity_reports""", "severity_reports"))
def q_map_severity(spark, sf):
    """Raw priorities normalised to high/med/low, unknown -> null."""
    r = td.severity_reports(spark, sf)
    return r.select("id", "severity", T.map_severity(F.col("severity"), td.ORDER_PRIORITY_SEVERITY).alias("level"))


@register("clean_label", f"""
    SELECT doc_id AS cluster, {s_clean_label('text', 'doc_id')} AS label FROM documents""")
def q_clean_label(spark, sf):
    """Cluster names cleaned from free text (first line, quotes, dots, 40 chars)."""
    d = td.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("cluster"), T.clean_label(F.col("text"), F.col("doc_id")).alias("label"))


@register("year_range", with_views("""
    SELECT CAST(min(year(creation_time)) AS INTEGER) AS first_year,
           CAST(max(year(creation_time)) AS INTEGER) AS last_year
    FROM severity_reports""", "severity_reports"))
def q_year_range(spark, sf):
    """First and last creation year."""
    return IN.year_range(td.severity_reports(spark, sf), "creation_time")


@register("as_id", """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_as_id(spark, sf):
    """Null-safe id cast of a value carried as text."""
    e = td.table(spark, sf, "events")
    return e.select("event_id", T.as_id(F.get_json_object("props", "$.k")).alias("k"))


@register("eligible_pool", with_views(f"""
    SELECT id, component FROM reports WHERE {s_words('description')} >= 40""", "reports"))
def q_eligible(spark, sf):
    """P5: candidate pool of reports with at least 40 description words."""
    return ST.eligible(ST.with_text(td.reports(spark, sf))).select("id", "component")
