import difflib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import extraction as EX
from tessera.operators import extraction as XO
from tessera.operators import trace as TR


def test_lenient_json_and_validation(spark):
    rows = [(1, "not json"), (2, "[1, 2]"), (3, '{"severity": "low", "kind": "ui"}'),
            (4, '{"area": "net", "severity": "urgent", "kind": "ui"}'),
            (5, '{"area": "net", "severity": "low", "kind": "bug"}'),
            (6, 'Sure!\n{"area": "net",\n "severity": "high", "kind": "crash"}\nthanks'),
            (7, '{"area": "  ", "severity": "low", "kind": "ui"}'), (8, '{"area": 5, "severity": "low", "kind": "ui"}')]
    df = spark.createDataFrame(rows, "id int, reply string")
    got = {r.id: (r.ok, r.reason) for r in XO.validate_replies(df).collect()}
    assert got[1] == (False, EX.REASON_NOT_OBJECT)
    assert got[2] == (False, EX.REASON_NOT_OBJECT)
    assert got[3] == (False, EX.REASON_MISSING_AREA)
    assert got[4] == (False, EX.REASON_BAD_SEVERITY)
    assert got[5] == (False, EX.REASON_BAD_KIND)
    assert got[6] == (True, "")
    assert got[7] == (False, EX.REASON_MISSING_AREA)
    assert got[8] == (False, EX.REASON_MISSING_AREA)


def test_nearest_name_matches_difflib(spark):
    values = ["Netwrk", "Graphics: WebRender", "DOM", "zzz", "ab"]
    names = ["Networking", "Graphics", "DOM: Core", "Layout", "ba", "ab "]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    t = spark.createDataFrame([(x,) for x in names], "component string")
    got = {r.value: r.name for r in XO.nearest_name(v, t, name_rows=2).collect()}
    for x in values:
        assert got[x] == difflib.get_close_matches(x, names, n=1, cutoff=0.0)[0]


def test_name_bounds_hold_and_best_equals_difflib():
    import random
    rnd = random.Random(3)

    def word(n):
        return "".join(rnd.choice("abcdeé: ") for _ in range(rnd.randint(0, n)))

    names = sorted({word(12) for _ in range(300)} | {"", "z" * 90, "ab" * 40})
    block = XO.NameBlock(names)
    looked = []
    plain = difflib.SequenceMatcher.ratio
    for value in [word(14) for _ in range(150)] + ["", "ab" * 30, "ab" * 45, "z" * 80, names[7]]:
        ratio = {n: difflib.SequenceMatcher(None, n, value).ratio() for n in names}
        shared = block.shared(value)
        rows = np.arange(len(block.names))
        lcs = block.subsequence(value, rows) if 0 < len(value) < 64 else shared
        for i, n in enumerate(block.names):
            m = ratio[n] * (len(n) + len(value)) / 2
            assert m <= lcs[i] + 1e-9 and lcs[i] <= shared[i] + 1e-9
        want = max((r, n) for n, r in ratio.items())
        difflib.SequenceMatcher.ratio = lambda self: looked.append(1) or plain(self)
        try:
            assert block.best(value) == want
            assert block.best(value, want[0]) == want and block.best(value, want[0] + 1e-6) is None
        finally:
            difflib.SequenceMatcher.ratio = plain
    assert len(looked) < 0.25 * 3 * 155 * len(names)


def test_nearest_name_over_blocks_of_many_lengths(spark):
    import random
    rnd = random.Random(9)

    def word(n):
        return "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, n)))

    names, values = sorted({word(30) for _ in range(200)} | {"abc"}), sorted({word(35) for _ in range(80)} | {"", "abc"})
    v = spark.createDataFrame([(x,) for x in values] * 2 + [(None,)], "value string")
    t = spark.createDataFrame([(x,) for x in names] + [(None,)], "component string")
    got = {r.value: (r.name, r.score) for r in XO.nearest_name(v, t, name_rows=16).collect()}
    assert set(got) == set(values)
    for x in values:
        want = max((difflib.SequenceMatcher(None, n, x).ratio(), n) for n in names)
        assert got[x] == (want[1], want[0])
    assert XO.nearest_name(v, t.limit(0)).collect() == [] and XO.nearest_name(v.limit(0), t).collect() == []


def trace_df(spark, runs):
    rows = [(rid, i, node, text) for rid, seq in runs.items() for i, (node, text) in enumerate(seq)]
    return spark.createDataFrame(rows, "run_id long, step long, node string, text string")


GOOD = '{"area": "net", "severity": "low", "kind": "ui"}'


def test_audit_routes(spark):
    runs = {1: [("critique", ""), ("extract", GOOD), ("critique", '{"ok": true}'), ("FINISH", "")],
            2: [("FINISH", ""), ("wander", "")],
            3: [("extract", GOOD), ("wander", "")],
            4: [("research", "")] * 11}
    out = {(r.run_id, r.step): (r.repaired, r.rule) for r in TR.audit_routes(trace_df(spark, runs)).collect()}
    assert out[(1, 0)] == ("extract", "no extraction yet")
    assert out[(1, 2)] == ("critique", "") and out[(1, 3)] == ("FINISH", "")
    assert out[(2, 0)] == ("extract", "no extraction yet")
    assert out[(2, 1)] == ("extract", "unknown route")
    assert out[(3, 1)] == ("critique", "unknown route")
    assert out[(4, 10)] == ("FINISH", "over budget") and out[(4, 9)] == ("research", "")


def test_attempts_and_outcomes(spark):
    runs = {1: [("extract", "garbage"), ("critique", ""), ("extract", GOOD), ("critique", '{"ok": true}'),
                ("FINISH", "")],
            2: [("extract", GOOD), ("critique", "unreadable"), ("extract", "junk")],
            3: [("research", ""), ("extract", GOOD), ("critique", '{"ok": false, "reason": "off"}')]}
    t = trace_df(spark, runs)
    att = {(r.run_id, r.step): r for r in TR.attempts(t).collect()}
    assert att[(1, 1)].ok is False and att[(1, 1)].reason == "schema error: not a JSON object"
    assert att[(1, 3)].ok is True and att[(1, 3)].attempt == 2 and att[(1, 3)].retry_of_rejection is True
    assert att[(2, 1)].ok is True  # unreadable critic reply counts as accepted
    assert att[(3, 2)].ok is False and att[(3, 2)].reason == "off"
    out = {r.run_id: r for r in TR.run_outcomes(t).collect()}
    assert out[1].ok is True and out[1].n_extract == 2
    assert out[2].ok is False  # re-extracted after the last critique
    assert out[3].ok is False and out[3].used_research is True
    y = TR.extraction_yield(TR.run_outcomes(t)).first()
    assert abs(y.final_yield - 1 / 3) < 1e-12 and y.first_pass_yield == 0.0


def test_signatures_and_digest(spark):
    runs = {1: [("research", ""), ("extract", ""), ("critique", ""), ("FINISH", "")], 2: [("odd", "")]}
    t = trace_df(spark, runs)
    sig = {r.run_id: r.signature for r in TR.signatures(t).collect()}
    assert sig == {1: "R→E→C→F  (4)", 2: "O  (1)"}
    long = trace_df(spark, {1: [(f"n{i}", "") for i in range(9)], 2: [("a", ""), ("b", "")]})
    dig = {r.run_id: r.digest for r in TR.evidence_digest(long, 6).collect()}
    assert dig[1] == [f"n{i}" for i in range(3, 9)] and dig[2] == ["a", "b"]


def test_score_rows_hook_and_failure_flag(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    ok = XO.score_rows(df, lambda pdf: pdf["text"].str.len().astype(str), "score").collect()
    assert sorted((r.id, r.score, r.score_failed) for r in ok) == [(1, "1", False), (2, "2", False)]

    def boom(pdf):
        raise RuntimeError("remote model down")
    bad = XO.score_rows(df, boom, "score").collect()
    assert all(r.score is None and r.score_failed for r in bad)


def test_judge_labels(spark):
    df = spark.createDataFrame([(1, '{"score": 5}'), (2, '{"score": 4}'), (3, "nope")], "id long, reply string")
    got = {r.id: (r.judge_good, r.parsed) for r in XO.judge_labels(df).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, False)}


def test_embed_hook_and_default(spark):
    from tessera.operators.embed import embed
    df = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, None)], "id long, text string")
    custom = embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2).collect()
    assert sorted((r.id, r.embedding) for r in custom) == [(1, [9.0, 1.0]), (2, [11.0, 1.0]), (3, [0.0, 1.0])]
    default = {r.id: r.embedding for r in embed(df, dims=64).collect()}
    assert len(default[1]) == 64 and abs(sum(x * x for x in default[1]) - 1.0) < 1e-5


def test_lenient_json_takes_whole_values_only(spark):
    good = '{"area": "x", "severity": "low", "kind": "ui"}'
    rows = [f"12 reports seen: {good}", f"true {good}", f'"sure" {good}', f"{good} or {good}", f"{good} trailing",
            f"{good}]", f"1] , [{good}", f' {good}\n', '{"a": 1} {"b": 2}']
    df = spark.createDataFrame(list(enumerate(rows)), "id int, reply string")
    got = {r.id: r.ok for r in XO.validate_replies(df).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_critic_verdict_by_truth_value(spark):
    replies = {'{"ok": null}': False, '{"ok": []}': False, '{"ok": ""}': False, '{"ok": 0}': False, '{"ok": 0.0}': False,
               '{"ok": {}}': False, '{"ok": false}': False, '{"ok": "no"}': True, '{"ok": "false"}': True,
               '{"ok": [0]}': True, '{"ok": 2}': True, "{}": True, "junk": True, '{"ok": false} junk': True}
    runs = {i: [("extract", GOOD), ("critique", text)] for i, text in enumerate(replies)}
    got = {r.run_id: r.ok for r in TR.attempts(trace_df(spark, runs)).collect()}
    assert [got[i] for i in range(len(replies))] == list(replies.values())


def test_agent_trace_reaches_every_rule(spark):
    from tessera.plans import testdata as td
    t = td.agent_trace(spark, "/root/testdata/sf0.01").drop("flagged").cache()
    rules = {r.rule for r in TR.audit_routes(t).select("rule").distinct().collect()}
    assert rules == {"", "over budget", "unknown route", "no extraction yet"}
    att = TR.attempts(t).collect()
    assert {r.reason for r in att} >= {f"schema error: {x}" for x in (
        EX.REASON_NOT_OBJECT, EX.REASON_MISSING_AREA, EX.REASON_BAD_SEVERITY, EX.REASON_BAD_KIND)}
    assert {(r.ok, r.retry_of_rejection) for r in att} == {(a, b) for a in (True, False) for b in (True, False)}
    y = TR.extraction_yield(TR.run_outcomes(t)).first()
    assert 0 < y.first_pass_yield < y.final_yield < 1
    assert all(r.errors > 0 for r in TR.tool_usage(t).collect() if r.tool in ("research", "FINISH", "summarise"))
    t.unpersist()


def test_nearest_name_equals_difflib_on_random_names(spark):
    import random
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeABC: ") for _ in range(rnd.randint(1, 14)))
    values, names = sorted({word() for _ in range(150)}), sorted({word() for _ in range(80)})
    v = spark.createDataFrame([(x,) for x in values], "value string")
    t = spark.createDataFrame([(x,) for x in names], "component string")
    got = {r.value: r.name for r in XO.nearest_name(v, t, name_rows=30).collect()}
    assert got == {x: difflib.get_close_matches(x, names, n=1, cutoff=0.0)[0] for x in values}


def test_one_bad_row_does_not_void_its_batch(spark):
    calls = []

    def judge(pdf):
        calls.append(len(pdf))
        if (pdf["id"] == 777).any():
            raise ValueError("bad row")
        return [f"s{i}" for i in pdf["id"]]

    import pandas as pd
    vals, failed = XO._scored(judge, pd.DataFrame({"id": range(10000)}))
    assert sum(failed) == 1 and failed[777] and vals[777] is None and vals[778] == "s778" and len(calls) < 40
    df = spark.range(2000).repartition(2)
    rows = XO.score_rows(df, lambda pdf: [1 / (i - 777) for i in pdf["id"]], "s", "double").collect()
    assert sum(r.s_failed for r in rows) == 1 and sum(r.s is not None for r in rows) == 1999
    short = XO.score_rows(df, lambda pdf: list(pdf["id"])[:1], "s", "long").collect()  # one value for many rows
    assert sorted(r.s for r in short) == list(range(2000))


def test_strict_json_is_parsed_once_and_whole(spark):
    import json

    from tessera.session import keep_last_json_key
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} x', "[1,2]", "1", "1,2", "1] x", '"s"', "", "null", "true", "tru", "[1],[2",
             '{"a":1,"a":2}', '{"a":{"b":[1,{"c":"}"}]}}', '{"a":1}{"b":2}', "-3.5e2", '{"a":"x\\"]}"}', '{"a":1},"="',
             '{"a":1}\n\n', "{}", "[]", '{"a"}', '{"k":"' + "y" * 20000 + '"}', "  ", "]", '","', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keep_last_json_key(spark)
    for r in df.select("t", F.to_json(EX.parse_json_strict("t")).alias("p")).collect():
        try:
            want = json.dumps(json.loads(r.t), separators=(",", ":"), ensure_ascii=False)
        except Exception:  # noqa: BLE001
            want = None
        assert r.p == want, r.t
    plan = XO.validate_replies(df.withColumnRenamed("t", "reply"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # the text, and its span from brace to brace


def test_repeated_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([('{"area": "old", "severity": "low", "kind": "ui", "area": "new"}',)], "reply string")
    r = XO.validate_replies(df).first()
    assert (r.ok, r.area) == (True, "new")


def test_catalog_decides_which_fields_are_checked(spark):
    ext = spark.createDataFrame([(1, "a", "x", 3), (2, "b", None, 4), (3, "a", "z", 3)],
                                "id long, grade string, other string, n int")
    cat = spark.createDataFrame([("grade", "d", ["a"]), ("n", "d", ["3"]), ("other", "free", None), ("gone", "d", ["q"])],
                                "field string, definition string, allowed array<string>")
    got = {r.field: (r.n, r.n_allowed, r.n_missing) for r in XO.catalog_conformance(ext, cat).collect()}
    assert got == {"grade": (3, 2, 0), "n": (3, 2, 0)}
    assert XO.catalog_conformance(ext.select("id"), cat).collect() == []
