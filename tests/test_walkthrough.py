"""The README walk-through, executed end to end on tables derived from sf0.001."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators import agreement as AG
from tessera.operators import cluster as CL
from tessera.operators import retrieval as R
from tessera.operators import stats as ST
from tessera.operators import trace as TR
from tessera.plans import testdata as td
from tessera.plans.report import readout
from tessera.sources import readers as RD

SF = "/root/testdata/sf0.001"


def test_readme_walkthrough(spark):
    base = tempfile.mkdtemp(prefix="tessera-walk-")
    # landed inputs in the reference's file formats
    RD.write_reports(td.reports(spark, SF, with_role=True), f"{base}/bugs.csv")
    RD.write_pairs(td.text_pairs(spark, SF), f"{base}/dup_pairs.csv")
    sheet = td.ratings(spark, SF).select("id", F.col("rater_a").cast("string").alias("human_good"))
    RD.write_csv(sheet, f"{base}/human_labels.csv")
    trace_df = td.decision_trace(spark, SF)
    judge_df = td.ratings(spark, SF).select("id", F.col("rater_b").alias("judge_good"))

    reports = ST.with_text(RD.land_reports(spark, f"{base}/bugs.csv", f"{base}/reports"))
    pairs = RD.read_pairs(spark, f"{base}/dup_pairs.csv")
    prof = ST.corpus_profile(reports, pairs).first()
    assert prof.n_reports == 200
    RD.append_vectors(reports.select("id", "component", "summary", "description"), f"{base}/vectors")
    vectors = spark.read.parquet(f"{base}/vectors").select("id", "embedding")
    k = CL.select_k(vectors, ks=(2, 3, 4), sample=200).filter("best").first()["k"]
    assign, centres = CL.fit_clusters(vectors, k)
    pts = vectors.join(assign, "id").withColumnRenamed("cluster", "label")
    reps = CL.representatives(pts, centres.withColumnRenamed("cluster", "label"), reports.select("id", "text"))
    themes = CL.apply_themes(pts.select("id", "label"), CL.name_clusters(reps))
    topics = ST.error_bars(ST.prevalence(themes, "theme", top=12))
    outcomes = TR.run_outcomes(trace_df)
    yields, trajs = TR.extraction_yield(outcomes), TR.trajectory_counts(trace_df, 8)
    labels = AG.usable_labels(RD.read_labels(spark, f"{base}/human_labels.csv"))
    kappa = AG.cohen_kappa(AG.align_ratings(labels, judge_df, "human_good", "judge_good"), "human_good", "judge_good")
    ranked, metrics = R.evaluate_retrieval(pairs, vectors, k=10)
    ctx = R.pair_context(ranked, reports, themes.select("id", "theme"))
    out = readout(topics, "theme", yields, kappa, metrics,
                  R.extremes(R.metrics_by(ctx, "theme", 50), "theme", "hit_at_10", 3), R.metrics_by_agreement(ctx))
    rows = out.collect()
    sections = {r.section for r in rows}
    assert {"themes", "extraction", "agreement", "retrieval"} <= sections
    assert trajs.count() > 0
    # copies of one text differ only in their "[component]" header, so every pair is found near the top
    m = metrics.first()
    assert m.n_pairs == pairs.count() and m.hit_at_5 == 1.0 and m.hit_at_1 <= m.mrr <= m.hit_at_10
