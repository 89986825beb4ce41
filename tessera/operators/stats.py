"""Corpus statistics: profile, counts, prevalence with Wilson intervals, priors."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed value: two-sided 95 % normal quantile.
Z_95 = 1.959963984540054


def z_for(alpha: float) -> float:
    return Z_95 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)


def with_text(reports: DataFrame) -> DataFrame:
    """Add ``text`` (P1) and ``desc_words`` (P2) to a report table."""
    return (reports.withColumn("text", T.compose_text("component", "summary", "description"))
            .withColumn("desc_words", T.word_count("description")))


def eligible(reports: DataFrame, min_words: int = 40) -> DataFrame:
    """Candidate pool: descriptions of at least ``min_words`` words (P5)."""
    return reports.filter(F.col("desc_words") >= min_words)


def corpus_profile(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows, pairs, distinct masters, description coverage and median words (A1).

    The median is exact (``median`` over an integer column keeps one counter
    per distinct word count, so its state is bounded by the longest text).
    """
    r = reports.agg(F.count(F.lit(1)).alias("n_reports"),
                    F.avg((F.col("desc_words") > 0).cast("double")).alias("desc_coverage"),
                    F.median(F.when(F.col("desc_words") > 0, F.col("desc_words"))).cast("double")
                    .alias("median_desc_words"))
    p = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("master_id").alias("n_masters"))
    one = F.lit(1)
    return r.withColumn("_one", one).join(p.withColumn("_one", one), "_one").drop("_one")


def counts_by(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Rows per value of ``by``."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, by: str, n: int, name: str = "n") -> DataFrame:
    """Top ``n`` values by count, ties by value ascending."""
    return counts_by(df, by, name).orderBy(F.col(name).desc(), F.col(by).asc()).limit(n)


def wilson(count_col, total_col, z: float = Z_95) -> tuple:
    """Wilson score interval (lo, hi) as columns."""
    n = total_col.cast("double")
    p = count_col.cast("double") / n
    z2 = z * z
    denom = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n)) / denom
    return centre - half, centre + half


def prevalence(df: DataFrame, by: str = "theme", top: int = 12, alpha: float = 0.05) -> DataFrame:
    """Top values of ``by`` with share over all non-null rows and a Wilson interval (A4).

    Counting is a partial aggregate; the total is a separate one-row
    aggregate joined back by broadcast (its size is one row by construction).
    """
    z = z_for(alpha)
    rows = df.filter(F.col(by).isNotNull())
    c = rows.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    total = rows.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    c = c.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    lo, hi = wilson(F.col("count"), F.col("_total"), z)
    out = (c.withColumn("share", F.col("count") / F.col("_total"))
           .withColumn("ci_lo", lo).withColumn("ci_hi", hi).drop("_total"))
    return out.orderBy(F.col("count").desc(), F.col(by).asc()).limit(top)


def error_bars(topics: DataFrame) -> DataFrame:
    """Chart-ready error bars: share - lo and hi - share (R2)."""
    return (topics.withColumn("err_lo", F.col("share") - F.col("ci_lo"))
            .withColumn("err_hi", F.col("ci_hi") - F.col("share")))


def first_n_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """First ``n`` rows per group by ``order``.

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle, so a hot group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(group).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def component_prior(reports: DataFrame, mapping: dict[str, str] | None = None,
                    examples: int = 3) -> DataFrame:
    """Per component: n, n mapped, share per level, typical level, examples.

    Typical level is the most frequent mapped level, the lowest on ties; the
    examples are the summaries of the lowest ``examples`` ids. All counts come
    from one aggregate by component and level, regrouped by component.
    """
    r = reports.select("id", "component", "summary",
                       T.map_severity(F.col("severity"), mapping).alias("level"))
    by_level = r.groupBy("component", "level").agg(F.count(F.lit(1)).alias("_n"))
    mapped = F.when(F.col("level").isNotNull(), F.col("_n"))
    per = (by_level.groupBy("component").agg(
        F.sum("_n").alias("n_bugs"), F.coalesce(F.sum(mapped), F.lit(0)).alias("n_triaged"),
        F.min(F.when(F.col("level").isNotNull(), F.struct((-F.col("_n")).alias("_m"), "level"))).alias("_top"),
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "_n")))).alias("_d"))
        .select("component", "n_bugs", "n_triaged", F.col("_top.level").alias("typical_severity"),
                F.when(F.size("_d") > 0, F.transform_values(F.map_from_entries("_d"), lambda k, v:
                       v / F.col("n_triaged"))).alias("severity_dist")))  # unrounded; rounding is display (Q12)
    ex = (first_n_per_group(r, "component", "id", examples)
          .groupBy("component")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "summary"))),
                           lambda s: s["summary"]).alias("example_summaries")))
    return per.join(ex, "component", "left")
