from tessera.operators import agreement as AG


def kappa(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int")
    return AG.cohen_kappa(df, "a", "b").first()


def test_kappa_cases(spark):
    assert abs(kappa(spark, [(1, 1), (0, 0), (1, 1), (0, 0)]).kappa - 1.0) < 1e-12
    # chance: po = .5, pe = .5
    assert abs(kappa(spark, [(1, 1), (1, 0), (0, 1), (0, 0)]).kappa) < 1e-12
    assert kappa(spark, [(1, 1), (1, 1)]).kappa is None  # one class only: pe = 1
    empty = kappa(spark, [(None, None)])
    assert empty.n == 0 and empty.kappa is None


def test_kappa_symmetric_and_known(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    k1 = kappa(spark, rows).kappa
    k2 = kappa(spark, [(b, a) for a, b in rows]).kappa
    po, pe = 35 / 50, (25 * 30 + 25 * 20) / 2500
    assert abs(k1 - (po - pe) / (1 - pe)) < 1e-12 and abs(k1 - k2) < 1e-12


def test_confusion_keeps_zeros(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "a int, b int")
    got = {(r.a, r.b): r.n for r in AG.confusion(df, "a", "b").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_usable_labels_and_annotated(spark):
    df = spark.createDataFrame([(1, "1"), (2, "0"), (3, ""), (4, "1.0"), (5, None)], "id long, human_good string")
    assert sorted(r.id for r in AG.usable_labels(df).collect()) == [1, 2, 4]
    assert AG.has_annotations(df).first().annotated is True
    blank = spark.createDataFrame([(1, ""), (2, None)], "id long, human_good string")
    assert AG.has_annotations(blank).first().annotated is False
