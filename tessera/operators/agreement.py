"""Rater agreement: usable labels, alignment, Cohen's kappa, confusion, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_labels(df: DataFrame, col: str = "human_good") -> DataFrame:
    """Rows whose label is 0 or 1 after a numeric cast; blanks dropped."""
    v = F.col(col).cast("string").try_cast("double")
    return df.filter(v.isin(0.0, 1.0)).withColumn(col, v.cast("int"))


def has_annotations(df: DataFrame, col: str = "human_good") -> DataFrame:
    """One row: does any row hold a 0/1 label?."""
    v = F.col(col).cast("string").try_cast("double")
    return df.agg(F.coalesce(F.max(v.isin(0.0, 1.0)), F.lit(False)).alias("annotated"))


def hold_out(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not in ``ids``."""
    return df.join(ids.select(F.col(id_col).alias("_hid")), F.col(id_col) == F.col("_hid"), "left_anti")


def align_ratings(a: DataFrame, b: DataFrame, a_col: str, b_col: str, id_col: str = "id") -> DataFrame:
    """Two raters joined on id, not by position."""
    return a.select(id_col, a_col).join(b.select(id_col, b_col), id_col, "inner")


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns.

    po = sum n_ii / n, pe = sum n_i. n_.i / n^2; null when n = 0 or pe = 1.
    Only the (a, b) cell counts are shuffled.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))
    ma = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("na"))
    mb = cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    tot = cells.agg(F.sum("n").alias("total"),
                    F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"))
    marg = ma.join(mb, "v", "full").agg(
        F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))).alias("pe_num"))
    one = F.lit(1)
    j = tot.withColumn("_one", one).join(marg.withColumn("_one", one), "_one", "left")
    n = F.col("total").cast("double")
    po = F.col("agree") / n
    pe = F.coalesce(F.col("pe_num"), F.lit(0)) / (n * n)
    kappa = F.when((F.col("total") > 0) & (pe < 1.0), (po - pe) / (F.lit(1.0) - pe))
    return j.select(F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("n"),
                    po.alias("po"), pe.alias("pe"), kappa.alias("kappa"))


def confusion(df: DataFrame, a: str, b: str, labels: Sequence = (0, 1)) -> DataFrame:
    """Counts for every (a, b) label pair in the given order, zeros kept."""
    lab = F.array(*[F.lit(x) for x in labels])
    counts = df.groupBy(F.col(a).alias(a), F.col(b).alias(b)).agg(F.count(F.lit(1)).alias("n"))
    grid = (df.sparkSession.range(1)
            .select(F.explode(lab).alias(a)).select(a, F.explode(lab).alias(b)))
    return (grid.join(counts, [a, b], "left")
            .select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def rating_summary(df: DataFrame, a: str, b: str, held_out: DataFrame | None = None,
                   id_col: str = "id") -> DataFrame:
    """Rows used and held out, positive rate per rater."""
    used = hold_out(df, held_out, id_col) if held_out is not None else df
    s = used.agg(F.count(F.lit(1)).alias("n_used"),
                 F.avg(F.col(a).cast("double")).alias(f"{a}_positive_rate"),
                 F.avg(F.col(b).cast("double")).alias(f"{b}_positive_rate"),
                 F.sum(F.col(a)).cast("long").alias(f"{a}_positive"),
                 F.sum(F.col(b)).cast("long").alias(f"{b}_positive"))
    t = df.agg(F.count(F.lit(1)).alias("n_total"))
    one = F.lit(1)
    j = s.withColumn("_one", one).join(t.withColumn("_one", one), "_one").drop("_one")
    return j.withColumn("n_held_out", F.col("n_total") - F.col("n_used"))

