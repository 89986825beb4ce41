"""Duplicate-retrieval evaluation: valid pairs, hit@k / MRR, slices, lift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import knn_join


def valid_pairs(pairs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs whose dup and master both appear in ``ids``.

    Two ``left_semi`` joins; self pairs and repeated pairs are kept (Q16).
    """
    keys = ids.select(F.col(id_col).cast("long").alias("_k")).distinct()
    return (pairs.join(keys, F.col("dup_id") == F.col("_k"), "left_semi")
            .join(keys, F.col("master_id") == F.col("_k"), "left_semi"))


def pair_ranks(pairs: DataFrame, nn: DataFrame) -> DataFrame:
    """Per pair: rank of the master among the dup's neighbours (null = miss) and rr."""
    hits = nn.select(F.col("qid").alias("dup_id"), F.col("id").alias("master_id"), "rank")
    return (pairs.join(hits, ["dup_id", "master_id"], "left")
            .withColumn("rr", F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))))


def retrieval_metrics(ranked: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """hit@k for each k and MRR@K over all pairs, misses counted as 0.

    ``ranked`` is ``pair_ranks`` output. Zero pairs give nulls, not an error.
    """
    aggs = [F.count(F.lit(1)).alias("n_pairs")]
    for k in ks:
        aggs.append(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}"))
    aggs.append(F.avg("rr").alias("mrr"))
    return ranked.agg(*aggs)


def evaluate_retrieval(pairs: DataFrame, vectors: DataFrame, k: int = 10,
                       ks: Sequence[int] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """Full retrieval evaluation: valid pairs -> k-nearest join -> ranks -> metrics.

    Only the distinct dup ids are searched; returns ``(per_pair, metrics)``.
    """
    vp = valid_pairs(pairs, vectors)
    queries = vectors.join(vp.select(F.col("dup_id").alias("id")).distinct(), "id", "left_semi")
    nn = knn_join(queries, vectors, k)
    ranked = pair_ranks(vp, nn)
    return ranked, retrieval_metrics(ranked, ks)


def pair_context(ranked: DataFrame, reports: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """Pairs with the master's theme and both components; unknown ids dropped."""
    r = reports.select(F.col("id").cast("long").alias("_id"), F.col("component").alias("_comp"))
    out = (ranked.join(r.withColumnRenamed("_id", "dup_id").withColumnRenamed("_comp", "dup_component"), "dup_id")
           .join(r.withColumnRenamed("_id", "master_id").withColumnRenamed("_comp", "master_component"),
                 "master_id"))
    if themes is not None:
        t = themes.select(F.col("id").cast("long").alias("master_id"), F.col("theme"))
        out = out.join(t, "master_id")
    return out


def metrics_by(ctx: DataFrame, by: str = "theme", min_n: int = 1, k: int = 10) -> DataFrame:
    """hit@k, MRR and n per slice with n >= min_n (all by default), ascending by hit@k, then name."""
    return (ctx.groupBy(by)
            .agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}"),
                 F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_n).orderBy(F.col(f"hit_at_{k}").asc(), F.col(by).asc()))


def extremes(slices: DataFrame, by: str, metric: str, n: int = 3) -> DataFrame:
    """Bottom ``n`` and top ``n`` slices by ``metric`` (W7), ties by name."""
    asc = Window.orderBy(F.col(metric).asc(), F.col(by).asc())
    desc = Window.orderBy(F.col(metric).desc(), F.col(by).desc())
    ranked = (slices.withColumn("_lo", F.row_number().over(asc))
              .withColumn("_hi", F.row_number().over(desc)))
    hard = ranked.filter(F.col("_lo") <= n).withColumn("end", F.lit("hardest")).withColumn("pos", F.col("_lo"))
    easy = ranked.filter(F.col("_hi") <= n).withColumn("end", F.lit("easiest")).withColumn("pos", F.col("_hi"))
    return hard.unionByName(easy).drop("_lo", "_hi").withColumn("pos", F.col("pos").cast("int"))


def metrics_by_agreement(ctx: DataFrame, k: int = 10) -> DataFrame:
    """Same- vs cross-component slices with their share of pairs."""
    g = (ctx.groupBy((F.col("dup_component") == F.col("master_component")).alias("same_component"))
         .agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}"),
              F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n")))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pair_cluster_lift(pairs: DataFrame, assign: DataFrame, attrs: DataFrame | None = None) -> DataFrame:
    """Same-cluster rate of pairs against the random baseline sum p^2.

    ``assign`` is ``(id, cluster)``; rows with a missing cluster leave both the
    rate and the baseline (Q13). ``attrs`` (``id, component``) adds the
    same-component rate with '' for missing values.
    """
    a = assign.select(F.col("id").cast("long").alias("_id"), F.col("cluster").alias("_cl")).filter(
        F.col("_cl").isNotNull())
    vp = valid_pairs(pairs, a, "_id")
    j = (vp.join(a.withColumnRenamed("_id", "dup_id").withColumnRenamed("_cl", "dup_cluster"), "dup_id")
         .join(a.withColumnRenamed("_id", "master_id").withColumnRenamed("_cl", "master_cluster"), "master_id"))
    aggs = [F.count(F.lit(1)).alias("n_pairs"),
            F.avg((F.col("dup_cluster") == F.col("master_cluster")).cast("double")).alias("same_cluster_rate")]
    if attrs is not None:
        c = attrs.select(F.col("id").cast("long").alias("_id"), F.coalesce(F.col("component"), F.lit("")).alias("_c"))
        j = (j.join(c.withColumnRenamed("_id", "dup_id").withColumnRenamed("_c", "dup_component"), "dup_id", "left")
             .join(c.withColumnRenamed("_id", "master_id").withColumnRenamed("_c", "master_component"),
                   "master_id", "left"))
        aggs.append(F.avg((F.coalesce(F.col("dup_component"), F.lit("")) ==
                           F.coalesce(F.col("master_component"), F.lit(""))).cast("double"))
                    .alias("same_component_rate"))
    rate = j.agg(*aggs)
    sizes = a.groupBy("_cl").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("random_baseline"))
    # Both sides are single-row aggregates; the constant key pairs them.
    one = F.lit(1)
    out = rate.withColumn("_one", one).join(base.withColumn("_one", one), "_one").drop("_one")
    return out.withColumn("lift", F.col("same_cluster_rate") / F.nullif(F.col("random_baseline"), F.lit(0.0)))


def pair_agreement(pairs: DataFrame, attrs: DataFrame, attr: str) -> DataFrame:
    """Per pair: both values of ``attr`` ('' when missing) and whether they agree."""
    c = attrs.select(F.col("id").cast("long").alias("_id"), F.col(attr).cast("string").alias("_v"))
    j = (pairs.join(c.withColumnRenamed("_id", "dup_id").withColumnRenamed("_v", "dup_value"), "dup_id", "left")
         .join(c.withColumnRenamed("_id", "master_id").withColumnRenamed("_v", "master_value"), "master_id", "left"))
    j = (j.withColumn("dup_value", F.coalesce("dup_value", F.lit("")))
         .withColumn("master_value", F.coalesce("master_value", F.lit(""))))
    return j.withColumn("agree", F.col("dup_value") == F.col("master_value"))
