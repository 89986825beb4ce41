"""Statistics queries: profile, counts, Wilson prevalence, priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as ST
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register
from tessera.plans.sqlparts import s_severity, s_wilson, s_words


@register("corpus_profile", with_views(f"""
    SELECT r.n_reports, r.desc_coverage, r.median_desc_words, p.n_pairs, p.n_masters FROM
      (SELECT count(*) AS n_reports, round(avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END), 6) AS desc_coverage,
              CAST(median(w) FILTER (WHERE w > 0) AS DOUBLE) AS median_desc_words
       FROM (SELECT {s_words('description')} AS w FROM reports)) r,
      (SELECT count(*) AS n_pairs, count(DISTINCT master_id) AS n_masters FROM text_pairs) p
    """, "reports", "text_pairs"))
def q_corpus_profile(spark, sf):
    """A1: rows, pairs, masters, description coverage, median words."""
    p = ST.corpus_profile(ST.with_text(td.reports(spark, sf)), td.text_pairs(spark, sf))
    return p.withColumn("desc_coverage", r6(F.col("desc_coverage")))


@register("role_counts", with_views("SELECT role, count(*) AS n FROM reports GROUP BY role", "reports"))
def q_role_counts(spark, sf):
    """A2: reports per role."""
    return ST.counts_by(td.reports(spark, sf, with_role=True), "role")


@register("component_counts", with_views("""
    SELECT component, count(*) AS n FROM reports GROUP BY component""", "reports"))
def q_component_counts(spark, sf):
    """A3: reports per component."""
    return ST.counts_by(td.reports(spark, sf), "component")


@register("taxonomy", with_views("""
    SELECT DISTINCT component FROM reports WHERE component IS NOT NULL""", "reports"))
def q_taxonomy(spark, sf):
    """Distinct component names, nulls dropped, sorted."""
    from tessera.sources.readers import taxonomy
    return taxonomy(td.reports(spark, sf))


def _prevalence_sql(src: str, by: str, top: int, views: tuple[str, ...]) -> str:
    lo, hi = s_wilson("count", "total")
    return with_views(f"""
    SELECT {by}, count, round(share, 6) AS share, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi,
           round(share - ci_lo, 6) AS err_lo, round(ci_hi - share, 6) AS err_hi
    FROM (SELECT {by}, count, count::DOUBLE / total AS share, {lo} AS ci_lo, {hi} AS ci_hi
          FROM (SELECT {by}, count(*) AS count, sum(count(*)) OVER () AS total
                FROM {src} WHERE {by} IS NOT NULL GROUP BY {by}))
    ORDER BY count DESC, {by} LIMIT {top}""", *views)


def _prevalence_df(df, by, top):
    out = ST.error_bars(ST.prevalence(df, by, top))
    return out.select(by, "count", *[r6(F.col(c)).alias(c) for c in
                                     ("share", "ci_lo", "ci_hi", "err_lo", "err_hi")])


@register("prevalence_themes", _prevalence_sql("vectors", "label", 12, ("vectors",)))
def q_prevalence_themes(spark, sf):
    """A4/R2: theme (label) shares with Wilson 95 % intervals and error bars."""
    return _prevalence_df(td.vectors(spark, sf), "label", 12)


@register("prevalence_components", _prevalence_sql("reports", "component", 12, ("reports",)))
def q_prevalence_components(spark, sf):
    """Top 12 components by count, ties by name, Wilson intervals."""
    return _prevalence_df(td.reports(spark, sf), "component", 12)


@register("top_languages", """
    SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3""")
def q_top_languages(spark, sf):
    """Top 3 values by count with ties by value."""
    return ST.top_counts(td.table(spark, sf, "documents"), "lang", 3)


@register("component_prior", with_views(f"""
    WITH r AS (SELECT id, component, summary,
                      {s_severity('severity', td.ORDER_PRIORITY_SEVERITY)} AS level FROM severity_reports),
    per AS (SELECT component, count(*) AS n_bugs, count(level) AS n_triaged FROM r GROUP BY component),
    lv AS (SELECT component, level, count(*) AS n FROM r WHERE level IS NOT NULL GROUP BY ALL),
    typ AS (SELECT component, level AS typical_severity FROM
              (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, level) AS rn FROM lv)
            WHERE rn = 1),
    dist AS (SELECT component, map_from_entries(list({{'k': level, 'v': round(n::DOUBLE / t, 6)}} ORDER BY level))
                    AS severity_dist
             FROM (SELECT *, sum(n) OVER (PARTITION BY component) AS t FROM lv) GROUP BY component),
    ex AS (SELECT component, list(summary ORDER BY id) AS example_summaries FROM
             (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) AS rn FROM r)
           WHERE rn <= 3 GROUP BY component)
    SELECT per.component, n_bugs, n_triaged, typical_severity, severity_dist, example_summaries
    FROM per LEFT JOIN typ USING (component) LEFT JOIN dist USING (component) LEFT JOIN ex USING (component)
    """.replace("WITH r AS", ", r AS", 1), "severity_reports"))
def q_component_prior(spark, sf):
    """Per-component severity prior with typical level and examples."""
    return ST.component_prior(td.severity_reports(spark, sf), td.ORDER_PRIORITY_SEVERITY).select(
        "component", "n_bugs", "n_triaged", "typical_severity",
        F.transform_values("severity_dist", lambda k, v: F.round(v, 6)).alias("severity_dist"), "example_summaries")
