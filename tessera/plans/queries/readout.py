"""The final readout query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans import testdata as td
from tessera.plans.registry import ORACLE, r6, register
from tessera.plans.report import readout
from tessera.plans.queries import retrieval, vectors  # noqa: F401  (their oracle SQL is reused below)
from tessera.plans.queries.agreement import q_cohen_kappa
from tessera.plans.queries.extraction import q_extraction_yield
from tessera.plans.queries.stats import q_prevalence_themes


def _strip_with(sql: str) -> str:
    return f"({sql})"


_READOUT_SQL = f"""
    SELECT 'themes' AS section, 'share' AS metric, CAST(label AS VARCHAR) AS slice, share AS value, count AS n
    FROM (SELECT * FROM {_strip_with(ORACLE['prevalence_themes'])} ORDER BY count DESC, label LIMIT 5)
    UNION ALL SELECT 'extraction', 'first_pass_yield', '', first_pass_yield, n_runs FROM {_strip_with(ORACLE['extraction_yield'])}
    UNION ALL SELECT 'extraction', 'final_yield', '', final_yield, n_runs FROM {_strip_with(ORACLE['extraction_yield'])}
    UNION ALL SELECT 'extraction', 'mean_steps', '', mean_steps, n_runs FROM {_strip_with(ORACLE['extraction_yield'])}
    UNION ALL SELECT 'agreement', 'kappa', '', kappa, n FROM {_strip_with(ORACLE['cohen_kappa'])}
    UNION ALL SELECT 'retrieval', 'hit_at_1', '', hit_at_1, n_pairs FROM {_strip_with(ORACLE['retrieval_metrics'])}
    UNION ALL SELECT 'retrieval', 'hit_at_5', '', hit_at_5, n_pairs FROM {_strip_with(ORACLE['retrieval_metrics'])}
    UNION ALL SELECT 'retrieval', 'hit_at_10', '', hit_at_10, n_pairs FROM {_strip_with(ORACLE['retrieval_metrics'])}
    UNION ALL SELECT 'retrieval', 'mrr', '', mrr, n_pairs FROM {_strip_with(ORACLE['retrieval_metrics'])}
    UNION ALL SELECT 'theme_slices', 'hit_at_10', "end" || ':' || CAST(theme AS VARCHAR), hit_at_10, n
              FROM {_strip_with(ORACLE['theme_extremes'])}
    UNION ALL SELECT 'component_slices', 'hit_at_10',
                     CASE WHEN same_component THEN 'same-component' ELSE 'cross-component' END, hit_at_10, n
              FROM {_strip_with(ORACLE['metrics_by_agreement'])}"""


@register("readout", _READOUT_SQL)
def q_readout(spark, sf):
    """The final readout table (themes, yields, kappa, retrieval, slices)."""
    # the per-pair ranks are built once; metrics and both slice tables derive from them
    ranked, metrics = R.evaluate_retrieval(td.vector_pairs(spark, sf), td.vectors(spark, sf), k=10)
    themes = td.vectors(spark, sf).select("id", F.col("label").alias("theme"))
    ctx = R.pair_context(ranked, td.reports(spark, sf), themes)
    rnd = [r6(F.col(c)).alias(c) for c in ("hit_at_10", "mrr")]
    ext = R.extremes(R.metrics_by(ctx, "theme", 50), "theme", "hit_at_10", 3).select("theme", *rnd, "n", "end")
    agree = R.metrics_by_agreement(ctx).select("same_component", *rnd, "n")
    met = metrics.select("n_pairs", *[r6(F.col(c)).alias(c) for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")])
    return readout(q_prevalence_themes(spark, sf), "label", q_extraction_yield(spark, sf),
                   q_cohen_kappa(spark, sf), met, ext, agree)
