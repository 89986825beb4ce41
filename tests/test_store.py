import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as RD
from tessera.sources.ingest import prefer_role
from tessera.sources.store import KeyedStore

SCHEMA = RD.T.StructType([RD.T.StructField("id", RD.T.LongType()), RD.T.StructField("v", RD.T.StringType())])


@pytest.fixture()
def path():
    return tempfile.mkdtemp(prefix="tessera-test-") + "/store"


def rows(spark, ids, v="x"):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_only_touched_buckets_are_read(spark, path):
    KeyedStore(spark, path, SCHEMA).append(rows(spark, range(500)))
    store = KeyedStore(spark, path, SCHEMA)
    asked = rows(spark, [3, 4, 1000])
    buckets = store.touched(asked)
    assert 1 <= len(buckets) <= 3 < store.buckets
    new = store.missing(asked)
    assert ids(new) == [1000]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and "PartitionFilters: [" in plan and "ReadSchema: struct<id:bigint>" in plan
    scan = store.part(buckets, ["id"])
    read = scan._jdf.queryExecution().executedPlan().toString()
    wanted = f"bucket#" + read.split("PartitionFilters: [")[1].split("bucket#")[1].split("]")[0]
    assert all(str(b) in wanted for b in buckets)
    assert {r[0] for r in scan.select(store.bucket("id")).distinct().collect()} <= set(buckets)
    assert scan.rdd.getNumPartitions() < store.read().rdd.getNumPartitions() or len(scan.inputFiles()) >= 1


def test_runs_replay_conflict_and_leftovers(spark, path):
    first, second = (KeyedStore(spark, path, SCHEMA) for _ in range(2))
    first.append(rows(spark, [1, 2]), run="a")
    with pytest.raises(Exception, match="[Aa]lready exists"):  # the other writer does not overwrite what came first
        second.append(rows(spark, [3]), run="b")
    again = KeyedStore(spark, path, SCHEMA)
    assert ids(again.read()) == [1, 2]  # files of the run that failed do not count
    again.append(rows(spark, [9]), run="a")  # a run that is live adds nothing
    again.append(rows(spark, [4]), run="b")  # the next attempt overwrites what the failed one left
    assert ids(KeyedStore(spark, path, SCHEMA).read()) == [1, 2, 4]
    assert ids(again.rows_of("b")) == [4]


def test_compaction_keeps_rows_and_file_counts_small(spark, path):
    for i in range(9):
        store = KeyedStore(spark, path, SCHEMA)
        store.append(rows(spark, range(20 * i, 20 * i + 20)), run=f"r{i}", origin="w")
        store.compact()
    store = KeyedStore(spark, path, SCHEMA)
    assert ids(store.read()) == list(range(180)) and len(store.runs) <= 4
    assert {r["origin"] for r in store.runs} == {"w"}
    store.vacuum()
    assert ids(KeyedStore(spark, path, SCHEMA).read()) == list(range(180))
    store.append(rows(spark, [5000]), run="r3")  # joined into another run meanwhile: still known
    assert ids(store.read()) == list(range(180))
    assert not KeyedStore(spark, path + "-none", SCHEMA).compact()


def test_appends_at_once_get_their_own_rows_back(spark, path):
    schema = "id long, component string, summary string, text string"
    one = RD.append_vectors(spark.createDataFrame([(1, "c", "s", "a")], schema), path)
    two = RD.append_vectors(spark.createDataFrame([(2, "c", "s", "b")], schema), path)
    assert ids(one) == [1] and ids(two) == [2]
    assert [r.version for r in one.collect()] == [1] and [r.version for r in two.collect()] == [2]
    none = RD.append_vectors(spark.createDataFrame([], schema), path)
    assert ids(none) == [] and ids(RD.read_vectors(spark, path)) == [1, 2]


def _land(spark, ids, path):
    rep = spark.createDataFrame([(i, f"s{i}", f"d {i}", "C") for i in ids],
                                "id long, summary string, description string, component string")
    rep.select(*[F.col(f.name) if f.name in rep.columns else F.lit(None).cast(f.dataType).alias(f.name)
                 for f in RD.REPORT_SCHEMA.fields]).write.parquet(path)


def test_stream_keeps_its_ids_in_state_not_in_the_store(spark, path, monkeypatch):
    from tessera.streaming.ingest import ingest_stream
    base = path + "-s"

    def run():
        ingest_stream(spark, base + "/src/*", base + "/store", checkpoint=base + "/ckpt").awaitTermination()

    looked = []
    plain = KeyedStore.part
    monkeypatch.setattr(KeyedStore, "part", lambda self, *a, **k: looked.append(a) or plain(self, *a, **k))
    _land(spark, [*range(5), *range(5)], base + "/src/a")
    run()
    _land(spark, range(3, 9), base + "/src/b")  # 3 old ids, 3 new ids, after a restart
    run()
    assert ids(RD.read_vectors(spark, base + "/store")) == list(range(9)) and looked == []
    # what another writer appends is found, by the touched buckets of that writer's runs alone
    RD.append_vectors(spark.createDataFrame([(20, "c", "s", "t")], "id long, component string, summary string, text string"),
                      base + "/store")
    looked.clear()
    _land(spark, [20, 21], base + "/src/c")
    run()
    assert ids(RD.read_vectors(spark, base + "/store")) == [*range(9), 20, 21] and len(looked) == 1


def test_replayed_micro_batch_adds_nothing(spark, path):
    schema = "id long, component string, summary string, text string"
    batch = spark.createDataFrame([(1, "c", "s", "a"), (2, "c", "s", "b")], schema)
    for _ in range(2):
        RD.append_vectors(batch, path, run="stream-7", origin="stream")
    assert ids(RD.read_vectors(spark, path)) == [1, 2]


def test_prefer_role_is_narrow_until_the_winner_is_known(spark):
    data = [(7, "corpus", f"t{i}", "x" * 50) for i in range(300)] + [(7, "dup", "win", "y"), (7, "dup", "win", "y"),
            (1, "master", "m", None), (None, "dup", "n", "z"), (2, None, "o", "z"), (2, "corpus", "p", "z")]
    df = spark.createDataFrame(data, "id long, role string, title string, text string").repartition(5)
    out = prefer_role(df)
    got = {r.id: (r.role, r.title) for r in out.collect()}
    assert got == {7: ("dup", "win"), 1: ("master", "m"), None: ("dup", "n"), 2: ("corpus", "p")}
    assert out.count() == 4 and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan
    narrow = [line for line in plan.splitlines() if "partial_min(_k" in line]
    assert narrow and all("text" not in line.split("functions=")[0] for line in narrow)
