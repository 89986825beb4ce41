from pyspark.sql import functions as F

from tessera.operators import agreement as AG
from tessera.operators import extraction as XO
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans.report import readout


def test_pair_cluster_lift(spark):
    assign = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, None)], "id long, cluster long")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 3), (5, 1)], "dup_id long, master_id long")
    comps = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, component string")
    r = R.pair_cluster_lift(pairs, assign, comps).first()
    assert r.n_pairs == 3                      # the pair touching the unclustered id 5 is left out
    assert abs(r.same_cluster_rate - 2 / 3) < 1e-12
    assert abs(r.random_baseline - 0.5) < 1e-12 and abs(r.lift - 4 / 3) < 1e-12
    assert abs(r.same_component_rate - 1 / 3) < 1e-12


def test_slices_and_extremes(spark):
    rows = [(i, 0, 1 if i % 2 else None, "t1", "a", "a") for i in range(4)] + \
           [(10 + i, 0, 1, "t2", "a", "b") for i in range(2)] + [(20, 0, None, "t3", "b", "b")]
    ctx = spark.createDataFrame(rows, "dup_id long, master_id long, rank int, theme string, "
                                      "dup_component string, master_component string")
    ctx = ctx.withColumn("rr", F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))
    m = {r.theme: (r.hit_at_10, r.n) for r in R.metrics_by(ctx, "theme", min_n=1).collect()}
    assert m == {"t1": (0.5, 4), "t2": (1.0, 2), "t3": (0.0, 1)}
    ex = {(r.end, r.pos): r.theme for r in R.extremes(R.metrics_by(ctx, "theme", 1), "theme", "hit_at_10", 1).collect()}
    assert ex == {("hardest", 1): "t3", ("easiest", 1): "t2"}
    ag = {r.same_component: (r.n, r.share) for r in R.metrics_by_agreement(ctx).collect()}
    assert ag[True][0] == 5 and abs(ag[False][1] - 2 / 7) < 1e-12


def test_lookup_found_flag(spark):
    reps = spark.createDataFrame([(1, "c", "s", "x" * 1300)], "id long, component string, summary string, "
                                                              "description string")
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    got = {r.id: r for r in V.lookup(ids, reps).collect()}
    assert got[1].found and len(got[1].description) == 1200
    assert not got[9].found and got[9].component is None


def test_rating_summary_hold_out(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 1)], "id long, a int, b int")
    held = spark.createDataFrame([(4,)], "id long")
    r = AG.rating_summary(df, "a", "b", held).first()
    assert (r.n_total, r.n_used, r.n_held_out) == (4, 3, 1)
    assert abs(r.a_positive_rate - 2 / 3) < 1e-12 and abs(r.b_positive_rate - 1 / 3) < 1e-12


def test_readout_sections(spark):
    topics = spark.createDataFrame([(f"t{i}", 10 - i, 0.1) for i in range(7)], "theme string, count long, share double")
    ext = spark.createDataFrame([(5, 0.4, 0.8, 5.2)], "n_runs long, first_pass_yield double, final_yield double, "
                                                      "mean_steps double")
    kappa = spark.createDataFrame([(0, None)], "n long, kappa double")
    met = spark.createDataFrame([(3, 0.1, 0.2, 0.3, 0.15)], "n_pairs long, hit_at_1 double, hit_at_5 double, "
                                                            "hit_at_10 double, mrr double")
    out = readout(topics, "theme", ext, kappa, met).collect()
    sections = [r.section for r in out]
    assert sections.count("themes") == 5 and sections.count("retrieval") == 4
    assert [r.value for r in out if r.metric == "kappa"] == [None]   # pending annotation


def test_nearest_name_ties_greatest(spark):
    v = spark.createDataFrame([("ab",)], "value string")
    t = spark.createDataFrame([("aa",), ("bb",)], "component string")
    got = XO.nearest_name(v, t).first()
    assert got.name == "bb"                    # equal ratio -> lexicographically greatest
    lev = XO.nearest_name(v, t, method="levenshtein").first()
    assert lev.name == "bb" and lev.score == -1.0
