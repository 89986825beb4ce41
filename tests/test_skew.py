"""Hot keys: one key holds a third of all rows. Results must stay exact and the
plans must pre-aggregate / pre-cut before the shuffle."""

import pandas as pd

from tessera.operators import agreement as AG
from tessera.operators import stats as ST


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(n=3000):
    rows = []
    for i in range(n):
        comp = "HOT" if i % 3 == 0 else f"c{i % 17}"
        rows.append((i, comp, ["major", "minor", "normal", "zz"][i % 4], f"s{i}"))
    return rows


def test_prevalence_hot_theme(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, theme string, severity string, summary string")
    out = ST.prevalence(df, "theme", top=3)
    got = [(r.theme, r["count"]) for r in out.collect()]
    pdf = pd.DataFrame(rows, columns=["id", "theme", "severity", "summary"])
    exp = pdf.groupby("theme").size().reset_index(name="n").sort_values(["n", "theme"], ascending=[False, True])
    assert got == list(zip(exp.theme[:3], exp.n[:3]))
    assert "partial_count" in plan_of(out)


def test_component_prior_hot_component(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, component string, severity string, summary string")
    out = ST.component_prior(df)
    hot = [r for r in out.collect() if r.component == "HOT"][0]
    assert hot.n_bugs == 1000 and hot.example_summaries == ["s0", "s3", "s6"]
    plan = plan_of(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_n_per_group_precut(spark):
    df = spark.createDataFrame(hot_rows(), "id long, component string, severity string, summary string")
    out = ST.first_n_per_group(df, "component", "id", 2)
    assert sorted(r.id for r in out.collect() if r.component == "HOT") == [0, 3]
    assert "WindowGroupLimit" in plan_of(out)


def test_kappa_hot_cell(spark):
    rows = [(1, 1)] * 3000 + [(0, 0)] * 10 + [(1, 0)] * 5 + [(0, 1)] * 5
    k = AG.cohen_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    n = len(rows)
    po = 3010 / n
    pe = (3005 * 3005 + 15 * 15) / n ** 2
    assert abs(k.kappa - (po - pe) / (1 - pe)) < 1e-12


def test_text_copies_hot_text(spark):
    from tessera.plans import testdata as td
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"t{i}", "en", "s", 1) for i in range(600)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    g = td._text_groups(docs)
    pairs = g.filter("doc_id <> master_id").collect()
    assert len(pairs) == 199 and {r.master_id for r in pairs} == {0}
