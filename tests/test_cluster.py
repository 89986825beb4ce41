import numpy as np

from tessera.operators import cluster as CL


def blobs(spark, centres, per, scale, seed=0, extra=()):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c, ctr in enumerate(centres):
        for _ in range(per):
            rows.append((i, [float(x) for x in np.asarray(ctr) + rng.normal(scale=scale, size=len(ctr))], c))
            i += 1
    for v, c in extra:
        rows.append((i, [float(x) for x in v], c))
        i += 1
    return spark.createDataFrame(rows, "id long, embedding array<float>, label long")


def silhouette_py(x, lab):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(n):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_exact_with_singleton(spark):
    df = blobs(spark, [[0, 0], [5, 5]], 20, 0.5, extra=[([10, -10], 2)])
    pts = df.collect()
    x = np.array([p.embedding for p in pts], dtype=np.float32).astype(np.float64)
    lab = np.array([p.label for p in pts])
    got = CL.silhouette(df).first().silhouette
    assert abs(got - silhouette_py(x, lab)) < 1e-9


def test_silhouette_grid_blocks(spark):
    df = blobs(spark, [[0, 0, 0], [3, 0, 0], [0, 3, 0]], 40, 1.0, seed=4)
    a = CL.silhouette_samples(df, left_rows=16, right_rows=16).agg({"s": "avg"}).first()[0]
    b = CL.silhouette(df).first().silhouette
    assert abs(a - b) < 1e-9


def test_kmeans_planted_purity_and_select_k(spark):
    df = blobs(spark, [[0, 0], [20, 0], [0, 20]], 30, 0.3, seed=1)
    assign, centres = CL.fit_clusters(df, 3, seed=42)
    from pyspark.sql import functions as F
    j = df.join(assign, "id").groupBy("label").agg(F.countDistinct("cluster")).collect()
    assert all(r[1] == 1 for r in j)
    assert centres.count() == 3
    sweep = CL.select_k(df, ks=(2, 3, 4), sample=90)
    best = [r.k for r in sweep.collect() if r.best]
    assert best == [3]


def test_centroids_and_representatives(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [2.0, 2.0], 0), (3, [10.0, 10.0], 1)],
                               "id long, embedding array<float>, label long")
    c = {r.label: r.centroid for r in CL.centroids(df).collect()}
    assert c[0] == [1.0, 1.0] and c[1] == [10.0, 10.0]
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, text string")
    reps = {r.label: r for r in CL.representatives(df, CL.centroids(df), texts, n=6).collect()}
    assert reps[0].samples == "- one\n- two" and reps[1].n_members == 1
    reps_df = CL.representatives(df, CL.centroids(df), texts)
    names = {r.label: r.theme for r in CL.name_clusters(reps_df).collect()}
    assert names == {0: "one", 1: "three"}


def test_fixed_sample_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    a = sorted(r.id for r in CL.fixed_sample(df.repartition(3), 50).collect())
    b = sorted(r.id for r in CL.fixed_sample(df.repartition(11), 50).collect())
    assert a == b and len(a) == 50


def test_silhouettes_one_pass_equals_single(spark):
    from pyspark.sql import functions as F
    df = blobs(spark, [[0, 0], [4, 0], [0, 4]], 25, 0.8, seed=9)
    df = df.withColumn("alt", (F.col("id") % 2).cast("long"))
    multi = {r.labelling: r.silhouette for r in CL.silhouettes(df, ["label", "alt"], left_rows=16,
                                                               right_rows=32).collect()}
    assert abs(multi["label"] - CL.silhouette(df, "label").first().silhouette) < 1e-9
    assert abs(multi["alt"] - CL.silhouette(df, "alt").first().silhouette) < 1e-9


def test_linear_silhouette_matches_pairs(spark):
    df = blobs(spark, [[0, 0], [3, 1]], 25, 1.0, seed=2, extra=[([9, 9], 2)])
    pts = df.collect()
    x = np.array([p.embedding for p in pts], dtype=np.float32).astype(np.float64)
    lab = np.array([p.label for p in pts])
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    got = CL.silhouettes_linear(df.repartition(4), ["label"]).first()
    assert got.n == 51 and abs(got.silhouette - np.mean(s)) < 1e-9


def test_select_k_uses_all_rows_in_few_jobs(spark):
    df = blobs(spark, [[0, 0], [20, 0], [0, 20], [20, 20]], 50, 0.3, seed=3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sweep", "sweep")
    sweep = CL.select_k(df, ks=tuple(range(2, 9))).collect()
    jobs = len(tracker.getJobIdsForGroup("sweep"))
    spark.sparkContext.setJobGroup("", "")
    assert [r.k for r in sweep if r.best] == [4] and jobs < 149


def test_start_sees_all_rows_not_a_sample(spark):
    """A few far rows among many: the start draws them by their distance, wherever they lie."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    far = {7: [3000.0, 0.0], 11111: [0.0, 3000.0], 19998: [-3000.0, -3000.0]}
    rows = [(i, far.get(i, [float(x) for x in rng.normal(size=2)])) for i in range(20000)]
    p = spark.createDataFrame(rows, "id long, _v array<float>").repartition(5)
    points, weight = CL.oversampled_seeds(p, 4, 1)
    assert weight.sum() == 20000 and len(points) <= 1 + CL.OVERSAMPLING_PASSES * CL.OVERSAMPLING * 4
    assert all(any(np.allclose(c, f) for c in points) for f in far.values())
    again, _ = CL.oversampled_seeds(p.repartition(3), 4, 1)
    assert np.array_equal(points, again)  # the draw does not depend on the partitions
    centres = CL.lockstep_kmeans(p, [4], 1)[4]
    assert all(np.abs(centres - f).sum(axis=1).min() < 1e-6 for f in far.values())
    same = p.select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("_v"))
    assert CL.lockstep_kmeans(same, [3], 1)[3].tolist() == [[1.0, 2.0]] * 3  # nothing else to draw


def test_memory_of_a_silhouette_cell():
    """Distances are held by tiles, not by whole rows of the cell."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    from tessera.operators import cluster
    v = np.random.default_rng(1).normal(size=(16384, 8)).astype(np.float32)
    side = [0] * 512 + [1] * 16384
    pdf = pd.DataFrame({"_side": side, "_id": range(len(side)), "_v": [*v[:512], *v],
                        "_l": [np.array([i % 3]) for i in range(len(side))]})
    tracemalloc.start()
    try:
        out = cluster._cell_cluster_sums(pdf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    lab = np.arange(512, len(side)) % 3
    want = np.linalg.norm(v[:1].astype(float) - v[lab == 2].astype(float), axis=1).sum()
    assert abs(out[(out.id == 0) & (out.other == 2)].dist_sum.iloc[0] - want) < 1e-4
