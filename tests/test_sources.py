import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import ingest as IN
from tessera.sources import readers as RD


def test_merge_priority(spark):
    m = spark.createDataFrame([(1,), (2,)], "id long")
    e = spark.createDataFrame([(1,), (3,)], "id long")
    d = spark.createDataFrame([(1,), (4,)], "id long")
    got = {r.id: r.role for r in IN.merge_sources(m, e, d).collect()}
    assert got == {1: "dup", 2: "master", 3: "corpus", 4: "dup"}


def test_csv_round_trip_multiline(spark):
    df = spark.createDataFrame([(1, 'He said "hi",\nthen left', "", "C", "dup"), (2, "x", " lead", None, "corpus")],
                               "id long, summary string, description string, component string, role string")
    path = tempfile.mkdtemp(prefix="tessera-test-") + "/r"
    RD.write_reports(df, path)
    back = {r.id: r for r in RD.read_reports(spark, path, null_tokens=["NA"]).collect()}
    assert back[1].summary == 'He said "hi",\nthen left' and back[1].description == ""
    assert back[2].description == " lead" and back[2].component == ""


def test_pages_and_first_comment(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    with open(os.path.join(d, "p.json"), "w") as f:
        f.write(json.dumps({"bugs": [{"id": 7, "summary": "s", "dupe_of": 3}, {"id": 8}]}) + "\n")
    rows = RD.explode_pages(spark, d).collect()
    assert [(r.id, r.dupe_of) for r in rows] == [(7, 3), (8, None)]
    c = tempfile.mkdtemp(prefix="tessera-test-")
    with open(os.path.join(c, "c.json"), "w") as f:
        f.write(json.dumps({"bugs": {"7": {"comments": [{"text": "first"}, {"text": "second"}]}}}) + "\n")
        f.write(json.dumps({"bugs": {"8": {"comments": []}}}) + "\n")
    got = {r.id: r.text for r in RD.first_comment(spark, c).collect()}
    assert got == {7: "first", 8: ""}
    with open(os.path.join(c, "9.json"), "w") as f:
        f.write("<html>unavailable\n")
    with open(os.path.join(c, "10.json"), "w") as f:
        f.write(json.dumps({"bugs": None}) + "\n")
    got = {r.id: r.text for r in RD.first_comment(spark, c).collect()}
    assert got == {7: "first", 8: "", 9: "", 10: ""}


def test_ids_and_years_are_read_exactly(spark):
    d = spark.createDataFrame([(1, "9007199254740993"), (2, "12.0"), (3, ""), (4, "x"), (5, " 7 ")],
                              "id long, dupe_of string")
    got = {r.id: r.dupe_of for r in IN.labelled_dups(d).collect()}
    assert got == {1: 9007199254740993, 2: 12, 4: None, 5: 7}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        y = spark.createDataFrame([("2020-12-31T20:00:00Z",)], "creation_time string")
        assert IN.year_range(y).first().last_year == 2020
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_literal_nan_description_is_kept(spark):
    from tessera.functions.text import compose_text
    df = spark.createDataFrame([("C", "s", "nan")], "c string, s string, d string")
    assert df.select(compose_text("c", "s", "d")).first()[0] == "[C] s\nnan"


def test_checkpoint_folder_is_never_made_up():
    import pytest

    from tessera import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_store_errors_other_than_a_missing_path_are_raised(spark):
    import pytest
    corpus = spark.createDataFrame([(1, "C", "s", "t")], "id long, component string, summary string, text string")
    with pytest.raises(Exception, match="nosuchscheme"):
        RD.append_vectors(corpus, "nosuchscheme://x/y")


def test_append_twice_stores_once(spark):
    path = tempfile.mkdtemp(prefix="tessera-test-") + "/v"
    corpus = spark.createDataFrame([(1, "C", "s", "alpha beta"), (2, "C", "t", "gamma")],
                                   "id long, component string, summary string, text string")
    RD.append_vectors(corpus, path)
    RD.append_vectors(corpus, path)
    more = spark.createDataFrame([(3, "D", "u", "delta")], "id long, component string, summary string, text string")
    RD.append_vectors(corpus.unionByName(more), path)
    got = RD.read_vectors(spark, path).groupBy("id").count().collect()
    assert sorted((r.id, r[1]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_stream_same_files_twice(spark):
    from tessera.streaming.ingest import ingest_stream, read_store
    base = tempfile.mkdtemp(prefix="tessera-test-")
    rep = spark.createDataFrame([(i, f"s{i}", f"d {i}", "C") for i in range(5)],
                                "id long, summary string, description string, component string")
    rep = rep.select(*[F.col(f.name) if f.name in rep.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in RD.REPORT_SCHEMA.fields])
    rep.write.parquet(base + "/src/a")
    rep.write.parquet(base + "/src/b")
    q = ingest_stream(spark, base + "/src/*", base + "/store", checkpoint=base + "/ckpt")
    q.awaitTermination()
    q2 = ingest_stream(spark, base + "/src/*", base + "/store", checkpoint=base + "/ckpt")
    q2.awaitTermination()
    assert read_store(spark, base + "/store").count() == 5


def test_field_catalog(spark):
    rows = {r.field: r.allowed for r in RD.field_catalog(spark).collect()}
    assert rows["severity"] == ["low", "med", "high"] and rows["area"] is None


def test_stream_restart_adds_only_new_ids(spark):
    from tessera.streaming.ingest import ingest_stream, read_store

    def drop(ids, path):
        rep = spark.createDataFrame([(i, f"s{i}", f"d {i}", "C") for i in ids],
                                    "id long, summary string, description string, component string")
        rep.select(*[F.col(f.name) if f.name in rep.columns else F.lit(None).cast(f.dataType).alias(f.name)
                     for f in RD.REPORT_SCHEMA.fields]).write.parquet(path)

    base = tempfile.mkdtemp(prefix="tessera-test-")
    drop(range(5), base + "/src/a")
    ingest_stream(spark, base + "/src/*", base + "/store", checkpoint=base + "/ckpt").awaitTermination()
    drop(range(3, 9), base + "/src/b")          # 3 old ids, 3 new ids
    ingest_stream(spark, base + "/src/*", base + "/store", checkpoint=base + "/ckpt").awaitTermination()
    ids = sorted(r.id for r in read_store(spark, base + "/store").collect())
    assert ids == list(range(9))


def test_reembed_changed_texts_only(spark):
    path = tempfile.mkdtemp(prefix="tessera-test-") + "/v"
    v1 = spark.createDataFrame([(1, "C", "s", "alpha beta"), (2, "C", "t", "gamma")],
                               "id long, component string, summary string, text string")
    RD.append_vectors(v1, path)
    v2 = spark.createDataFrame([(1, "C", "s", "alpha beta"), (2, "C", "t", "gamma delta"), (3, "D", "u", "new")],
                               "id long, component string, summary string, text string")
    RD.append_vectors(v2, path)                        # id-keyed: only id 3 is added
    assert spark.read.parquet(path).count() == 3
    RD.append_vectors(v2, path, reembed_changed=True)  # content-keyed: id 2 changed -> new version
    raw = spark.read.parquet(path)
    assert raw.count() == 4
    latest = {r.id: r.text for r in RD.latest_vectors(spark, path).collect()}
    assert latest == {1: "alpha beta", 2: "gamma delta", 3: "new"}
    assert RD.read_vectors(spark, path, latest=True).count() == 3


def test_latest_vectors_hot_id_many_versions(spark):
    path = tempfile.mkdtemp(prefix="tessera-test-") + "/v"
    rows = [(7, [float(v)], f"t{v}", ("C", "s"), v, v) for v in range(300)] + [(8, [1.0], "x", ("C", "s"), 1, 1)]
    spark.createDataFrame(rows, RD.VECTOR_SCHEMA).repartition(6).write.parquet(path)
    got = {r.id: (r.text, r.version) for r in RD.latest_vectors(spark, path).collect()}
    assert got == {7: ("t299", 299), 8: ("x", 1)}
