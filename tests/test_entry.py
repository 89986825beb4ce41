import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["n_pairs", "hit_at_1", "hit_at_5", "hit_at_10", "mrr"]
    r = rows[0]
    assert r.hit_at_1 <= r.hit_at_5 <= r.hit_at_10
    assert r.hit_at_1 <= r.mrr <= r.hit_at_10


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_retrieval_figures_sf001(spark):
    # exact values over the label-derived pairs (490 pairs, noise vectors)
    r = E.queries()["retrieval_metrics"](spark, "/root/testdata/sf0.01").first()
    assert r.n_pairs == 490
    assert (r.hit_at_1, round(r.hit_at_5, 4), round(r.hit_at_10, 4), round(r.mrr, 5)) == (0.0, 0.0122, 0.0306, 0.00632)


def test_entry_figures_sf0001(spark):
    r = E.entry(spark).first()
    assert r.n_pairs == 490
    assert (r.hit_at_1, r.hit_at_5, round(r.hit_at_10, 4), round(r.mrr, 5)) == (0.0, 0.0, 0.0143, 0.00186)


def test_package_shipped_to_workers(spark):
    import zipfile

    from tessera.session import ship_package
    ship_package(spark)  # idempotent per application
    files = spark.sparkContext._jsc.sc().listFiles()
    names = [files.apply(i) for i in range(files.size())]
    zips = [n for n in names if n.endswith("tessera.zip")]
    assert len(zips) == 1
    path = zips[0].replace("file:", "", 1)
    with zipfile.ZipFile(path) as zf:
        assert "tessera/operators/vectors.py" in zf.namelist()
