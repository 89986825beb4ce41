"""Property checks: many generated cases per Spark job."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import agreement as AG
from tessera.operators import retrieval as R
from tessera.operators import stats as ST

cases = st.lists(st.tuples(st.integers(1, 10_000), st.floats(0, 1)), min_size=50, max_size=200)


@settings(max_examples=5, deadline=None)
@given(cases)
def test_wilson_contains_share(spark, cs):
    rows = [(int(round(f * n)), n) for n, f in cs]
    df = spark.createDataFrame(rows, "c long, n long")
    lo, hi = ST.wilson(F.col("c"), F.col("n"))
    bad = df.select((F.col("c") / F.col("n")).alias("p"), lo.alias("lo"), hi.alias("hi")).filter(
        (F.col("lo") < -1e-12) | (F.col("hi") > 1 + 1e-12) | (F.col("lo") > F.col("p") + 1e-12)
        | (F.col("hi") < F.col("p") - 1e-12))
    assert bad.count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=5, max_size=300))
def test_kappa_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int")
    k1 = AG.cohen_kappa(df, "a", "b").first().kappa
    k2 = AG.cohen_kappa(df, "b", "a").first().kappa
    assert (k1 is None and k2 is None) or (abs(k1 - k2) < 1e-12 and -1 - 1e-12 <= k1 <= 1 + 1e-12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 10)), min_size=1, max_size=300))
def test_hit_and_mrr_ordering(spark, ranks):
    rows = [(i, 10_000 + i, r) for i, r in enumerate(ranks)]
    df = spark.createDataFrame(rows, "dup_id long, master_id long, rank int")
    df = df.withColumn("rr", F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))
    m = R.retrieval_metrics(df).first()
    assert m.hit_at_1 <= m.hit_at_5 <= m.hit_at_10
    assert m.hit_at_1 - 1e-12 <= m.mrr <= m.hit_at_10 + 1e-12
