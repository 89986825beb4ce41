"""Sampling, k-means, k sweep and the approximate vector index."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import cluster as CL
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register


@register("fixed_sample", with_views("""
    SELECT id, component FROM reports ORDER BY md5('42|' || id), id LIMIT 50""", "reports"))
def q_fixed_sample(spark, sf):
    """U4: 50 reports chosen by a seeded hash of the id."""
    return CL.fixed_sample(td.reports(spark, sf).select("id", "component"), 50, 42)


@register("restrict_pairs", with_views("""
    , smp AS (SELECT id FROM reports ORDER BY md5('42|' || id), id LIMIT 600)
    SELECT dup_id, master_id FROM text_pairs
    WHERE dup_id IN (SELECT id FROM smp) AND master_id IN (SELECT id FROM smp)""", "text_pairs", "reports"))
def q_restrict_pairs(spark, sf):
    """Copy pairs restricted to a 600-report seeded sample."""
    smp = CL.fixed_sample(td.reports(spark, sf).select("id"), 600, 42)
    return R.valid_pairs(td.text_pairs(spark, sf), smp)


@register("fit_clusters")
def q_fit_clusters(spark, sf):
    """K-means (k = 10, seed 42) over all vectors; assignment per id."""
    assign, _ = CL.fit_clusters(td.vectors(spark, sf), 10, 42)
    return assign


@register("cluster_fixed_point", """
    SELECT count(*) AS n, CAST(10 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n_not_nearest, CAST(0 AS BIGINT) AS n_not_means
    FROM embeddings""")
def q_cluster_fixed_point(spark, sf):
    """K-means (k = 10) run until nothing moves; rows not at their nearest centre, centres not their rows' mean."""
    from tessera.session import cut_lineage
    v = cut_lineage(td.vectors(spark, sf).select("id", F.col("embedding").alias("_v")))
    centres = CL.lockstep_kmeans(v, [10], 42, max_iter=500, tol=0.0)[10]
    rows = CL._assigned(v, {10: centres}, ["c"])
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)],
                                  "centre long, at array<double>")  # k rows
    gap = F.aggregate(F.zip_with("_v", "at", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0),
                      lambda s, x: s + x)
    far = rows.join(F.broadcast(table)).withColumn("d", gap).groupBy("id", "c").agg(
        F.min("d").alias("least"), F.min(F.when(F.col("centre") == F.col("c"), F.col("d"))).alias("own"))
    means = (rows.select("c", F.posexplode("_v").alias("i", "x")).groupBy("c", "i").agg(
        F.avg(F.col("x").cast("double")).alias("mean")).join(F.broadcast(table), F.col("c") == F.col("centre"))
        .groupBy("c").agg(F.max(F.abs(F.col("mean") - F.get("at", F.col("i")))).alias("off")))
    return far.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("n_not_nearest")).join(
        means.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("off") > 1e-9).alias("n_not_means"))).select(
        "n", "k", "n_not_nearest", "n_not_means")


@register("select_k")
def q_select_k(spark, sf):
    """K sweep 8..24 step 2 over all vectors by the linear silhouette."""
    return CL.select_k(td.vectors(spark, sf))


def _index_search(spark, sf, k=10):
    """An index of all vectors written to the shared folder, and its answer for every vector, cut from it."""
    from tessera.operators import ivf
    from tessera.plans.queries.sources import read_then_remove, scratch
    v, path = td.vectors(spark, sf), scratch(spark, "index")
    ivf.build_index(v, path, k=k)
    return read_then_remove(spark, ivf.search_index(v, path, k), path)


@register("knn_index")
def q_knn_index(spark, sf):
    """J4 (index): approximate top 10 per vector from a stored inverted file."""
    return _index_search(spark, sf)


@register("knn_index_recall", """
    SELECT count(*) * 10 AS n_true, true AS at_least_090, true AS scores_exact FROM embeddings""")
def q_knn_index_recall(spark, sf):
    """J4 (index): its recall@10 against the exact join over all vectors, and whether common pairs score alike."""
    v = td.vectors(spark, sf)
    true = V.knn_join(v, v, k=10).select("qid", "id", F.col("sim").alias("exact"))
    both = true.join(_index_search(spark, sf), ["qid", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_true"), (F.count("sim") >= 0.9 * F.count(F.lit(1))).alias("at_least_090"),
                    F.bool_and(F.coalesce(F.col("sim") == F.col("exact"), F.lit(True))).alias("scores_exact"))


@register("silhouette_linear", with_views("""
    , c AS (SELECT label, count(*) AS n, sum(list_inner_product(v, v)) AS ss FROM
              (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) GROUP BY label),
    d AS (SELECT e.vec_id AS id, e.label AS own, c.label AS other, c.n,
                 c.n * list_inner_product(e.v, e.v) + c.ss - 2 * c.n * list_inner_product(e.v, m.centroid) AS total
          FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e
          JOIN c ON true JOIN centroids m ON m.label = c.label),
    ab AS (SELECT id, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a,
                  min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY id)
    SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""", "centroids"))
def q_silhouette_linear(spark, sf):
    """A5 (linear): mean squared-Euclidean silhouette of the label clusters over all vectors."""
    s = CL.silhouettes_linear(td.vectors(spark, sf), ["label"])
    return s.select("n", r6(F.col("silhouette")).alias("silhouette"))


@register("knn_copies", with_views("""
    , v AS (SELECT vec_id * 10 + c AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings,
                   unnest(range(CASE WHEN vec_id % 50 = 0 THEN 8 ELSE 1 END)) AS u(c)),
    q AS (SELECT * FROM v WHERE id % 500 < 10),
    s AS (SELECT q.id AS qid, v.id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e))
                 * sqrt(list_inner_product(v.e, v.e))), 9) AS sim FROM q JOIN v ON q.id <> v.id)
    SELECT qid, CAST(rn AS INTEGER) AS rank, id, round(sim, 6) AS sim FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM s) WHERE rn <= 5""", "vectors"))
def q_knn_copies(spark, sf):
    """J4/W1 under ties: every 50th vector planted eight times, exact top 5 of those copies, ties by id."""
    v = td.vectors(spark, sf)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 50 == 0, F.lit(7)).otherwise(F.lit(0))))
    v = v.select("id", "embedding", copies.alias("c")).select((F.col("id") * 10 + F.col("c")).alias("id"), "embedding")
    nn = V.knn_join(v.filter(F.col("id") % 500 < 10), v, k=5)
    return nn.select("qid", "rank", "id", r6(F.col("sim")).alias("sim"))


@register("judge_labels", with_views("""
    , s AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 3 THEN NULL ELSE len(component) END AS score FROM reports)
    SELECT id, score IS NOT NULL AS parsed, CASE WHEN score >= 5 THEN 1 ELSE 0 END AS judge_good FROM s""", "reports"))
def q_judge_labels(spark, sf):
    """A judge function scores every report (every fourth reply is unreadable), binarised at 5."""
    import json

    from tessera.operators import extraction as XO

    def judge(pdf):
        return [json.dumps({"score": len(c)}) if i % 4 != 3 else "I cannot say" for i, c in
                zip(pdf["id"], pdf["component"], strict=True)]
    replies = XO.score_rows(td.reports(spark, sf).select("id", "component"), judge, "reply")
    return XO.judge_labels(replies).select("id", "parsed", "judge_good")
