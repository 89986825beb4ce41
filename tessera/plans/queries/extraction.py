"""Extraction and agent-trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.extraction import KINDS as EX_KINDS, SEVERITIES as EX_SEVERITIES
from tessera.functions import text as T
from tessera.operators import extraction as XO
from tessera.operators import trace as TR
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register
from tessera.plans.sqlparts import s_field, s_lenient, s_reason


_DT = """
    , dt AS (SELECT run_id, step, CASE node WHEN 'user' THEN 'research' WHEN 'assistant' THEN 'extract'
                    WHEN 'system' THEN 'critique' ELSE node END AS node, text FROM trace)"""

_SIG = ("string_agg(CASE node WHEN 'research' THEN 'R' WHEN 'extract' THEN 'E' WHEN 'critique' THEN 'C' "
        "WHEN 'FINISH' THEN 'F' ELSE upper(left(node, 1)) END, '→' ORDER BY step) || '  (' || count(*) || ')'")


@register("trajectory", with_views(_DT + """
    SELECT run_id, string_agg(node, ' → ' ORDER BY step) AS trajectory FROM dt GROUP BY run_id""", "trace"))
def q_trajectory(spark, sf):
    """Per run, decisions in order joined by ' → '."""
    return TR.trajectory(td.decision_trace(spark, sf))


@register("signatures", with_views(_DT + f"""
    SELECT run_id, {_SIG} AS signature FROM dt GROUP BY run_id""", "trace"))
def q_signatures(spark, sf):
    """Per run signature such as 'C→R→E  (3)'."""
    return TR.signatures(td.decision_trace(spark, sf))


@register("trajectory_counts", with_views(_DT + f"""
    SELECT signature, count(*) AS n FROM (SELECT run_id, {_SIG} AS signature FROM dt GROUP BY run_id)
    GROUP BY signature ORDER BY n DESC, signature LIMIT 8""", "trace"))
def q_trajectory_counts(spark, sf):
    """The 8 most frequent trajectory signatures."""
    return TR.trajectory_counts(td.decision_trace(spark, sf), 8)


@register("trajectory_summary", with_views(_DT + f"""
    SELECT count(*) AS n_runs, count(DISTINCT signature) AS n_distinct
    FROM (SELECT run_id, {_SIG} AS signature FROM dt GROUP BY run_id)""", "trace"))
def q_trajectory_summary(spark, sf):
    """Runs and distinct trajectories."""
    return TR.trajectory_summary(td.decision_trace(spark, sf))


@register("extract_counts", with_views(_DT + """
    SELECT run_id, CAST(count(*) FILTER (WHERE node = 'extract') AS INTEGER) AS n_extract,
           CAST(count(*) AS INTEGER) AS steps, bool_or(node = 'research') AS used_research
    FROM dt GROUP BY run_id""", "trace"))
def q_extract_counts(spark, sf):
    """Extractions, steps and research use per run."""
    return TR.extract_counts(td.decision_trace(spark, sf))


_AT = ", dt AS (SELECT run_id, step, node, text FROM agent_trace)"


@register("tool_usage", with_views(_AT + """
    SELECT node AS tool, count(*) AS calls, count(*) FILTER (WHERE text LIKE '%"error"%') AS errors,
           count(DISTINCT run_id) AS runs
    FROM dt GROUP BY node""", "agent_trace"))
def q_tool_usage(spark, sf):
    """Calls, error replies and runs per tool."""
    return TR.tool_usage(td.agent_trace(spark, sf))


@register("evidence_digest", with_views(_DT + """
    SELECT run_id, list_slice(a, greatest(len(a) - 5, 1), len(a)) AS digest
    FROM (SELECT run_id, list(coalesce(node, 'note') ORDER BY step) AS a FROM dt GROUP BY run_id)""", "trace"))
def q_evidence_digest(spark, sf):
    """The last 6 evidence items of every run."""
    return TR.evidence_digest(td.decision_trace(spark, sf), 6)


_STATE = f"""
    , st AS (
      SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS idx,
             coalesce(last_value(CASE WHEN node = 'extract' THEN {s_lenient('text')} IS NOT NULL END IGNORE NULLS)
                      OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS has_extraction,
             last_value(CASE WHEN node = 'extract' THEN coalesce({s_lenient('text')}, 'null') END IGNORE NULLS)
                      OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur,
             CAST(sum(CASE WHEN node = 'extract' THEN 1 ELSE 0 END)
                  OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS attempt
      FROM dt WINDOW w AS (PARTITION BY run_id ORDER BY step))"""


@register("audit_routes", with_views(_AT + _STATE + """
    , a AS (SELECT *, CASE WHEN idx >= 10 THEN 'FINISH'
                           WHEN (CASE WHEN node IN ('research', 'extract', 'critique', 'FINISH') THEN node
                                      WHEN has_extraction THEN 'critique' ELSE 'extract' END)
                                IN ('critique', 'FINISH') AND NOT has_extraction THEN 'extract'
                           ELSE (CASE WHEN node IN ('research', 'extract', 'critique', 'FINISH') THEN node
                                      WHEN has_extraction THEN 'critique' ELSE 'extract' END) END AS repaired
            FROM st)
    SELECT run_id, step, node, has_extraction, repaired, node = repaired AS legal,
           CASE WHEN idx >= 10 THEN 'over budget'
                WHEN node NOT IN ('research', 'extract', 'critique', 'FINISH') THEN 'unknown route'
                WHEN node IN ('critique', 'FINISH') AND NOT has_extraction THEN 'no extraction yet'
                ELSE '' END AS rule
    FROM a""", "agent_trace"))
def q_audit_routes(spark, sf):
    """Per decision, the route the supervisor rules would allow."""
    return TR.audit_routes(td.agent_trace(spark, sf), 10)


_ATTEMPTS = f"""
    , cr AS (
      SELECT run_id, step, attempt,
             {s_reason("CASE WHEN cur IS NULL OR cur = 'null' THEN NULL ELSE cur END")} AS why,
             CASE WHEN json_valid(text) THEN text END AS rep
      FROM st WHERE node = 'critique'),
    att AS (
      SELECT run_id, step, attempt,
             CASE WHEN why = '' THEN coalesce(json_extract(rep, '$.ok')::VARCHAR NOT IN
                                              ('null', 'false', '0', '""', '[]', '{{}}'), true)
                  ELSE false END AS ok,
             CASE WHEN why <> '' THEN 'schema error: ' || why
                  ELSE coalesce(json_extract_string(rep, '$.reason'), '') END AS reason
      FROM cr)"""


@register("attempts", with_views(_AT + _STATE + _ATTEMPTS + """
    SELECT run_id, step, attempt, ok, reason,
           coalesce(NOT lag(ok) OVER (PARTITION BY run_id ORDER BY step), false) AS retry_of_rejection
    FROM att""", "agent_trace"))
def q_attempts(spark, sf):
    """Critic verdicts with attempt number, rejection reason and retries."""
    return TR.attempts(td.agent_trace(spark, sf))


@register("extraction_yield", with_views(_AT + _STATE + _ATTEMPTS + """
    , runs AS (SELECT run_id, CAST(count(*) FILTER (WHERE node = 'extract') AS INTEGER) AS n_extract,
                      count(*) AS steps, bool_or(node = 'research') AS used_research,
                      max(CASE WHEN node = 'extract' THEN step END) AS le FROM dt GROUP BY run_id),
    fin AS (SELECT a.run_id, arg_max(a.ok, a.step) AS ok FROM att a JOIN runs r USING (run_id)
            WHERE r.le IS NULL OR a.step > r.le GROUP BY a.run_id),
    o AS (SELECT r.*, coalesce(f.ok, false) AS ok FROM runs r LEFT JOIN fin f USING (run_id))
    SELECT count(*) AS n_runs, round(avg(ok::DOUBLE), 6) AS final_yield,
           round(avg((ok AND n_extract = 1)::DOUBLE), 6) AS first_pass_yield,
           round(avg(steps::DOUBLE), 6) AS mean_steps, round(avg((NOT used_research)::DOUBLE), 6) AS no_research_share,
           round(avg(ok::DOUBLE) - avg((ok AND n_extract = 1)::DOUBLE), 6) AS gain,
           count(*) FILTER (WHERE run_id IN (SELECT run_id FROM agent_trace WHERE flagged)) AS n_flagged
    FROM o""", "agent_trace"))
def q_extraction_yield(spark, sf):
    """Final / first-pass yield, gain, mean steps, share without research, flagged runs."""
    t = td.agent_trace(spark, sf)
    y = TR.extraction_yield(TR.run_outcomes(t.drop("flagged")), t.filter("flagged").select("run_id"))
    return y.select("n_runs", *[r6(F.col(c)).alias(c) for c in
                                ("final_yield", "first_pass_yield", "mean_steps", "no_research_share", "gain")],
                    "n_flagged")


@register("validate_extractions", with_views(f"""
    SELECT id, p IS NOT NULL AS parsed, {s_field('p', 'area')} AS area, {s_field('p', 'severity')} AS severity,
           {s_field('p', 'kind')} AS kind, {s_reason('p')} = '' AS ok, {s_reason('p')} AS reason
    FROM replies""", "replies"))
def q_validate_extractions(spark, sf):
    """Lenient parse and schema check of model-style replies."""
    v = XO.validate_replies(td.extraction_replies(spark, sf))
    return v.select("id", "parsed", "area", "severity", "kind", "ok", "reason")


@register("annotation_template", with_views(f"""
    SELECT id, component, summary, left(reply, 1200) AS description, {s_field('p', 'area')} AS llm_area,
           {s_field('p', 'severity')} AS llm_severity, {s_field('p', 'kind')} AS llm_kind,
           CAST(NULL AS INTEGER) AS human_good
    FROM replies WHERE {s_reason('p')} = ''""", "replies"))
def q_annotation_template(spark, sf):
    """Accepted extractions as a blank annotation sheet."""
    from tessera.sources.readers import annotation_template
    v = XO.validate_replies(td.extraction_replies(spark, sf))
    ext = v.select("id", "component", "summary", F.col("reply").alias("description"),
                   F.col("area").alias("llm_area"), F.col("severity").alias("llm_severity"),
                   F.col("kind").alias("llm_kind"), "ok")
    return annotation_template(ext)


@register("nearest_region_levenshtein", """
    SELECT value, name, score FROM (
      SELECT n.n_name AS value, r.r_name AS name, -CAST(levenshtein(n.n_name, r.r_name) AS DOUBLE) AS score,
             row_number() OVER (PARTITION BY n.n_name ORDER BY levenshtein(n.n_name, r.r_name), r.r_name DESC) AS rn
      FROM (SELECT DISTINCT n_name FROM nation) n JOIN (SELECT DISTINCT r_name FROM region) r ON true)
    WHERE rn = 1""")
def q_nearest_region_levenshtein(spark, sf):
    """J15 (edit distance): closest region name for every nation name."""
    return XO.nearest_name(td.table(spark, sf, "nation"), td.table(spark, sf, "region"), "n_name", "r_name",
                           method="levenshtein")


@register("nearest_region")
def q_nearest_region(spark, sf):
    """Closest region name for every nation name by difflib ratio, no cutoff."""
    return XO.nearest_name(td.table(spark, sf, "nation"), td.table(spark, sf, "region"), "n_name", "r_name")


@register("nearest_component")
def q_nearest_component(spark, sf):
    """Extracted areas matched to the report component taxonomy (difflib)."""
    v = XO.validate_replies(td.extraction_replies(spark, sf)).select(F.col("area").alias("value"))
    from tessera.sources.readers import taxonomy
    return XO.nearest_name(v, taxonomy(td.reports(spark, sf)), "value", "component")


@register("extraction_json", with_views(f"""
    SELECT id, json_object('area', {s_field('p', 'area')}, 'severity', {s_field('p', 'severity')},
                           'kind', {s_field('p', 'kind')})::VARCHAR AS extraction
    FROM replies""", "replies"))
def q_extraction_json(spark, sf):
    """Extracted fields serialised back to one JSON object per reply."""
    v = XO.validate_replies(td.extraction_replies(spark, sf))
    return v.select("id", T.extraction_json("area", "severity", "kind").alias("extraction"))


@register("catalog_conformance", with_views(f"""
    , lng AS (SELECT 'severity' AS field, {s_field('p', 'severity')} AS value FROM replies
              UNION ALL SELECT 'kind', {s_field('p', 'kind')} FROM replies),
    allowed AS (SELECT * FROM (VALUES {", ".join(f"('severity', '{v}')" for v in EX_SEVERITIES)},
                                      {", ".join(f"('kind', '{v}')" for v in EX_KINDS)}) t(field, value))
    SELECT l.field, count(*) AS n, count(a.value) AS n_allowed, count(*) FILTER (WHERE l.value IS NULL) AS n_missing
    FROM lng l LEFT JOIN allowed a ON a.field = l.field AND a.value = l.value GROUP BY l.field""", "replies"))
def q_catalog_conformance(spark, sf):
    """The field catalog as a dimension table, checked against every reply."""
    from tessera.sources.readers import field_catalog
    v = XO.validate_replies(td.extraction_replies(spark, sf))
    return XO.catalog_conformance(v, field_catalog(spark))
