import math

from pyspark.sql import functions as F

from tessera.operators import stats as ST


def wilson_py(c, n, z=ST.Z_95):
    p = c / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return centre - half, centre + half


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (1, 1), (3, 8)], "c long, n long")
    lo, hi = ST.wilson(F.col("c"), F.col("n"))
    got = df.select(lo.alias("lo"), hi.alias("hi"), "c", "n").collect()
    for r in got:
        elo, ehi = wilson_py(r.c, r.n)
        assert abs(r.lo - elo) < 1e-12 and abs(r.hi - ehi) < 1e-12
        assert -1e-12 <= r.lo <= r.c / r.n + 1e-12 and r.c / r.n <= r.hi + 1e-12 <= 1 + 2e-12


def test_prevalence_ties_and_top(spark):
    rows = [("b",)] * 3 + [("a",)] * 3 + [("c",)] * 1 + [(None,)] * 5
    df = spark.createDataFrame(rows, "theme string")
    out = ST.prevalence(df, "theme", top=2).collect()
    assert [r.theme for r in out] == ["a", "b"]
    assert all(abs(r.share - 3 / 7) < 1e-12 for r in out)


def test_component_prior(spark):
    rows = [(1, "A", "major", "s1"), (2, "A", "minor", "s2"), (3, "A", "zz", "s3"), (4, "A", "normal", "s4"),
            (5, "B", None, "t1")]
    df = spark.createDataFrame(rows, "id long, component string, severity string, summary string")
    out = {r.component: r for r in ST.component_prior(df).collect()}
    a = out["A"]
    assert (a.n_bugs, a.n_triaged) == (4, 3)
    assert a.typical_severity == "high"  # tie high/low/med -> lowest value
    assert a.example_summaries == ["s1", "s2", "s3"]
    assert abs(a.severity_dist["high"] - 1 / 3) < 1e-6
    b = out["B"]
    assert (b.n_bugs, b.n_triaged, b.typical_severity) == (1, 0, None)


def test_corpus_profile(spark):
    rep = spark.createDataFrame([(1, 0), (2, 4), (3, 6), (4, 10)], "id long, desc_words int")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "dup_id long, master_id long")
    r = ST.corpus_profile(rep, pairs).first()
    assert (r.n_reports, r.n_pairs, r.n_masters) == (4, 3, 2)
    assert r.desc_coverage == 0.75 and r.median_desc_words == 6.0
