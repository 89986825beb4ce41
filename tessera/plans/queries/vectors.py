"""Vector and cluster queries: neighbours, slices, centroids, silhouette."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import cluster as CL
from tessera.operators import retrieval as R
from tessera.operators import stats as ST
from tessera.operators import vectors as V
from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import r6, register
from tessera.plans.sqlparts import VIEWS_RTEXT, s_clean_label


def _rtext(spark, sf):
    return ST.with_text(td.reports(spark, sf)).select("id", "text")


@register("enrich_neighbours", with_views("""
    SELECT k.qid, k.rank, k.id, round(k.sim, 3) AS sim, r.component, left(r.summary, 120) AS summary
    FROM knn6 k JOIN reports r ON k.id = r.id""", "knn6", "reports"))
def q_enrich_neighbours(spark, sf):
    """Top-6 neighbours with component and 120-char summary, unknown ids dropped."""
    v = td.vectors(spark, sf)
    return V.enrich_neighbours(V.knn_join(v, v, k=6), td.reports(spark, sf))


_FLAGS_SQL = """
    SELECT qid, rank, id, sim3 FROM (
      SELECT qid, rank, id, round(sim, 3) AS sim3,
             row_number() OVER (PARTITION BY qid ORDER BY rank) AS fr
      FROM knn6 WHERE round(sim, 3) >= 0.45)
    WHERE fr <= 5"""


def _flags(spark, sf):
    v = td.vectors(spark, sf)
    return V.near_duplicates(V.knn_join(v, v, k=6), min_sim=0.45, limit=5)


@register("near_duplicates", with_views(_FLAGS_SQL, "knn6"))
def q_near_duplicates(spark, sf):
    """Neighbours with rounded similarity >= .45, first 5 of 6."""
    return _flags(spark, sf).select("qid", "rank", "id", "sim3")


@register("flag_ids", with_views(f"""
    SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS dup_ids FROM ({_FLAGS_SQL}) GROUP BY qid""",
                                 "knn6"))
def q_flag_ids(spark, sf):
    """Flagged neighbour ids comma-joined in rank order."""
    return V.flag_ids(_flags(spark, sf))


@register("lookup", with_views("""
    SELECT v.id, r.id IS NOT NULL AS found, r.component, r.summary, left(r.description, 1200) AS description
    FROM vectors v LEFT JOIN reports r ON v.id = r.id""", "vectors", "reports"))
def q_lookup(spark, sf):
    """Report lookup for every vector id, with a found flag."""
    return V.lookup(td.vectors(spark, sf).select("id"), td.reports(spark, sf))


@register("reciprocal_rank", with_views("""
    SELECT p.dup_id, p.master_id, k.rank, round(coalesce(1.0 / k.rank, 0.0), 6) AS rr
    FROM vector_pairs p LEFT JOIN knn10 k ON k.qid = p.dup_id AND k.id = p.master_id""",
                                        "vector_pairs", "knn10"))
def q_reciprocal_rank(spark, sf):
    """Rank and reciprocal rank of the true master per pair."""
    ranked, _ = R.evaluate_retrieval(td.vector_pairs(spark, sf), td.vectors(spark, sf), k=10)
    return ranked.select("dup_id", "master_id", "rank", r6(F.col("rr")).alias("rr"))


_CTX_SQL = """
    ctx AS (
      SELECT p.dup_id, p.master_id, k.rank, coalesce(1.0 / k.rank, 0.0) AS rr,
             rd.component AS dup_component, rm.component AS master_component, v.label AS theme
      FROM vector_pairs p LEFT JOIN knn10 k ON k.qid = p.dup_id AND k.id = p.master_id
      JOIN reports rd ON rd.id = p.dup_id JOIN reports rm ON rm.id = p.master_id
      JOIN vectors v ON v.id = p.master_id)"""


def _ctx(spark, sf):
    ranked, _ = R.evaluate_retrieval(td.vector_pairs(spark, sf), td.vectors(spark, sf), k=10)
    themes = td.vectors(spark, sf).select("id", F.col("label").alias("theme"))
    return R.pair_context(ranked, td.reports(spark, sf), themes)


@register("pair_context", with_views(f", {_CTX_SQL.strip()}\n"
                                     "SELECT dup_id, master_id, rank, dup_component, master_component, theme FROM ctx",
                                     "vector_pairs", "knn10", "reports", "vectors"))
def q_pair_context(spark, sf):
    """Pairs with both components and the master's theme."""
    return _ctx(spark, sf).select("dup_id", "master_id", "rank", "dup_component", "master_component", "theme")


_SLICES_SQL = """
    slices AS (
      SELECT theme, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS hit_at_10, avg(rr) AS mrr, count(*) AS n
      FROM ctx GROUP BY theme HAVING count(*) >= 50)"""


@register("metrics_by_theme", with_views(f", {_CTX_SQL.strip()}, {_SLICES_SQL.strip()}\n"
                                         "SELECT theme, round(hit_at_10, 6) AS hit_at_10, round(mrr, 6) AS mrr, n "
                                         "FROM slices", "vector_pairs", "knn10", "reports", "vectors"))
def q_metrics_by_theme(spark, sf):
    """hit@10, MRR and n per master theme with n >= 50."""
    m = R.metrics_by(_ctx(spark, sf), "theme", 50)
    return m.select("theme", r6(F.col("hit_at_10")).alias("hit_at_10"), r6(F.col("mrr")).alias("mrr"), "n")


@register("theme_extremes", with_views(f", {_CTX_SQL.strip()}, {_SLICES_SQL.strip()}" + """
    SELECT theme, round(hit_at_10, 6) AS hit_at_10, round(mrr, 6) AS mrr, n, 'hardest' AS "end",
           CAST(lo AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (ORDER BY hit_at_10, theme) AS lo FROM slices)
    WHERE lo <= 3
    UNION ALL
    SELECT theme, round(hit_at_10, 6), round(mrr, 6), n, 'easiest', CAST(hi AS INTEGER)
    FROM (SELECT *, row_number() OVER (ORDER BY hit_at_10 DESC, theme DESC) AS hi FROM slices) WHERE hi <= 3""",
                                       "vector_pairs", "knn10", "reports", "vectors"))
def q_theme_extremes(spark, sf):
    """Hardest and easiest 3 themes by hit@10."""
    m = R.metrics_by(_ctx(spark, sf), "theme", 50)
    e = R.extremes(m, "theme", "hit_at_10", 3)
    return e.select("theme", r6(F.col("hit_at_10")).alias("hit_at_10"), r6(F.col("mrr")).alias("mrr"), "n",
                    "end", "pos")


@register("metrics_by_agreement", with_views(f", {_CTX_SQL.strip()}" + """
    SELECT dup_component = master_component AS same_component,
           round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10, round(avg(rr), 6) AS mrr,
           count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM ctx GROUP BY 1""", "vector_pairs", "knn10", "reports", "vectors"))
def q_metrics_by_agreement(spark, sf):
    """Same- vs cross-component hit@10, MRR and share of pairs."""
    m = R.metrics_by_agreement(_ctx(spark, sf))
    return m.select("same_component", r6(F.col("hit_at_10")).alias("hit_at_10"), r6(F.col("mrr")).alias("mrr"),
                    "n", r6(F.col("share")).alias("share"))


@register("pair_cluster_lift", with_views("""
    , a AS (SELECT id, label AS cl FROM vectors WHERE label IS NOT NULL),
    vp AS (SELECT p.* FROM text_pairs p WHERE dup_id IN (SELECT id FROM a) AND master_id IN (SELECT id FROM a)),
    j AS (SELECT vp.*, ad.cl AS dc, am.cl AS mc, coalesce(rd.component, '') AS dcomp,
                 coalesce(rm.component, '') AS mcomp
          FROM vp JOIN a ad ON ad.id = vp.dup_id JOIN a am ON am.id = vp.master_id
          LEFT JOIN reports rd ON rd.id = vp.dup_id LEFT JOIN reports rm ON rm.id = vp.master_id),
    rate AS (SELECT count(*) AS n_pairs, avg(CASE WHEN dc = mc THEN 1.0 ELSE 0.0 END) AS same_cluster_rate,
                    avg(CASE WHEN dcomp = mcomp THEN 1.0 ELSE 0.0 END) AS same_component_rate FROM j),
    base AS (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS random_baseline
             FROM (SELECT cl, count(*) AS n FROM a GROUP BY cl))
    SELECT n_pairs, round(same_cluster_rate, 6) AS same_cluster_rate,
           round(same_component_rate, 6) AS same_component_rate, round(random_baseline, 6) AS random_baseline,
           round(same_cluster_rate / nullif(random_baseline, 0), 6) AS lift
    FROM rate, base""", "vectors", "text_pairs", "reports"))
def q_pair_cluster_lift(spark, sf):
    """Same-cluster rate of copy pairs vs the random baseline, and lift."""
    assign = td.vectors(spark, sf).select("id", F.col("label").alias("cluster"))
    out = R.pair_cluster_lift(td.text_pairs(spark, sf), assign, td.reports(spark, sf))
    return out.select("n_pairs", *[r6(F.col(c)).alias(c) for c in
                                   ("same_cluster_rate", "same_component_rate", "random_baseline", "lift")])


@register("pair_agreement", with_views("""
    SELECT p.dup_id, p.master_id, coalesce(rd.lang, '') AS dup_value, coalesce(rm.lang, '') AS master_value,
           coalesce(rd.lang, '') = coalesce(rm.lang, '') AS agree
    FROM vector_pairs p LEFT JOIN reports rd ON rd.id = p.dup_id LEFT JOIN reports rm ON rm.id = p.master_id""",
                                       "vector_pairs", "reports"))
def q_pair_agreement(spark, sf):
    """Per pair, language of both sides ('' when missing) and agreement."""
    return R.pair_agreement(td.vector_pairs(spark, sf), td.reports(spark, sf), "lang")


@register("cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    """Members per cluster."""
    return CL.cluster_sizes(td.vectors(spark, sf))


@register("centroids", with_views("""
    SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM centroids""", "centroids"))
def q_centroids(spark, sf):
    """Mean vector per cluster."""
    c = CL.centroids(td.vectors(spark, sf))
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


_REPS_SQL = f"""
    , rtext AS ({VIEWS_RTEXT}),
    j AS (SELECT e.vec_id AS id, e.label, r.text,
                 list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid) AS dist
          FROM embeddings e JOIN centroids c USING (label) JOIN rtext r ON r.id = e.vec_id),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS rn FROM j)
            WHERE rn <= 6),
    reps AS (SELECT label, count(*) AS n_members,
                    string_agg('- ' || left(text, 200), chr(10) ORDER BY rn) AS samples,
                    arg_min(text, rn) AS nearest_text
             FROM top GROUP BY label)"""


def _reps(spark, sf):
    v = td.vectors(spark, sf)
    return CL.representatives(v, CL.centroids(v), _rtext(spark, sf), 6)


@register("representatives", with_views(_REPS_SQL + "\nSELECT label, n_members, samples FROM reps",
                                        "centroids", "reports"))
def q_representatives(spark, sf):
    """Six members nearest to each centroid as '- text[:200]' lines."""
    return _reps(spark, sf).select("label", "n_members", "samples")


@register("apply_themes", with_views(_REPS_SQL + f"""
    , names AS (SELECT label, {s_clean_label('nearest_text', 'label')} AS theme FROM reps)
    SELECT v.id, v.label, n.theme FROM vectors v LEFT JOIN names n USING (label)""",
                                     "centroids", "reports", "vectors"))
def q_apply_themes(spark, sf):
    """Every vector with the name of its cluster (default namer)."""
    names = CL.name_clusters(_reps(spark, sf))
    return CL.apply_themes(td.vectors(spark, sf).select("id", "label"), names)


@register("silhouette", with_views("""
    SELECT count(*) AS n, round(avg(s), 6) AS silhouette FROM silhouette_points""", "silhouette_points"))
def q_silhouette(spark, sf):
    """A5: exact Euclidean mean silhouette of the label clusters."""
    s = CL.silhouette(td.vectors(spark, sf))
    return s.select("n", r6(F.col("silhouette")).alias("silhouette"))


@register("silhouette_by_cluster", with_views("""
    SELECT label, count(*) AS n, round(avg(s), 6) AS silhouette, round(avg(a), 6) AS mean_a,
           round(avg(b), 6) AS mean_b FROM silhouette_points GROUP BY label""", "silhouette_points"))
def q_silhouette_by_cluster(spark, sf):
    """A5: per-cluster mean silhouette and its a/b terms."""
    s = CL.silhouette_samples(td.vectors(spark, sf))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("s")).alias("silhouette"),
                                  r6(F.avg("a")).alias("mean_a"), r6(F.avg("b")).alias("mean_b"))


@register("vector_math", with_views("""
    SELECT p.dup_id, p.master_id,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
           round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2,
           round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot
    FROM vector_pairs p JOIN embeddings a ON a.vec_id = p.dup_id JOIN embeddings b ON b.vec_id = p.master_id""",
                                    "vector_pairs"))
def q_vector_math(spark, sf):
    """Cosine, Euclidean distance and dot product of every labelled pair."""
    v = td.vectors(spark, sf).select("id", "embedding")
    j = (td.vector_pairs(spark, sf)
         .join(v.withColumnRenamed("id", "dup_id").withColumnRenamed("embedding", "a"), "dup_id")
         .join(v.withColumnRenamed("id", "master_id").withColumnRenamed("embedding", "b"), "master_id"))
    return j.select("dup_id", "master_id", r6(VF.cosine("a", "b")).alias("cosine"),
                    r6(VF.l2_distance("a", "b")).alias("l2"), r6(VF.dot("a", "b")).alias("dot"))


@register("similarity", with_views("""
    SELECT p.dup_id, p.master_id, round(1 - (1 - list_cosine_similarity(
           CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 3) AS sim
    FROM vector_pairs p JOIN embeddings a ON a.vec_id = p.dup_id JOIN embeddings b ON b.vec_id = p.master_id""",
                                   "vector_pairs"))
def q_similarity(spark, sf):
    """Similarity from the cosine distance of every labelled pair."""
    from tessera.functions import text as T
    v = td.vectors(spark, sf).select("id", "embedding")
    j = (td.vector_pairs(spark, sf)
         .join(v.withColumnRenamed("id", "dup_id").withColumnRenamed("embedding", "a"), "dup_id")
         .join(v.withColumnRenamed("id", "master_id").withColumnRenamed("embedding", "b"), "master_id"))
    return j.select("dup_id", "master_id", T.similarity(F.lit(1.0) - VF.cosine("a", "b")).alias("sim"))


@register("copy_retrieval")
def q_copy_retrieval(spark, sf):
    """Documents embedded (default hashed TF-IDF), copy pairs retrieved, hit@k and MRR."""
    from tessera.operators.embed import embed
    from tessera.session import cut_lineage
    reports = ST.with_text(td.reports(spark, sf)).select("id", "text")
    # the vectors are read three times below: computed once, without the texts
    vectors = cut_lineage(embed(reports).select("id", "embedding"))
    _, m = R.evaluate_retrieval(td.text_pairs(spark, sf), vectors, k=10)
    return m.select("n_pairs", *[r6(F.col(c)).alias(c) for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")])
