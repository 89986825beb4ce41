"""Final readout (R1): one long table gathering every section.

Rows are ``(section, metric, slice, value, n)``; each input is an already
aggregated (small) DataFrame, so the readout is a union of projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READOUT_SCHEMA = "section string, metric string, slice string, value double, n long"


def _rows(df: DataFrame, section: str, metric: str, value: str, slice_col: str | None = None,
          n_col: str | None = None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                     (F.col(slice_col).cast("string") if slice_col else F.lit("")).alias("slice"),
                     F.col(value).cast("double").alias("value"),
                     (F.col(n_col).cast("long") if n_col else F.lit(None).cast("long")).alias("n"))


def readout(topics: DataFrame, theme_col: str, extraction: DataFrame, kappa: DataFrame,
            metrics: DataFrame, extremes: DataFrame | None = None, agreement: DataFrame | None = None,
            top_themes: int = 5) -> DataFrame:
    """Top themes, yields, kappa (null = pending), hit@k / MRR, slices."""
    top = topics.orderBy(F.col("count").desc(), F.col(theme_col).asc()).limit(top_themes)
    parts = [_rows(top, "themes", "share", "share", theme_col, "count")]
    for m in ("first_pass_yield", "final_yield", "mean_steps"):
        parts.append(_rows(extraction, "extraction", m, m, None, "n_runs"))
    parts.append(_rows(kappa, "agreement", "kappa", "kappa", None, "n"))
    for m in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr"):
        parts.append(_rows(metrics, "retrieval", m, m, None, "n_pairs"))
    if extremes is not None:
        ex = extremes.withColumn("_slice", F.concat_ws(":", F.col("end"), F.col("theme").cast("string")))
        parts.append(_rows(ex, "theme_slices", "hit_at_10", "hit_at_10", "_slice", "n"))
    if agreement is not None:
        ag = agreement.withColumn("_slice", F.when(F.col("same_component"), F.lit("same-component"))
                                  .otherwise(F.lit("cross-component")))
        parts.append(_rows(ag, "component_slices", "hit_at_10", "hit_at_10", "_slice", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
