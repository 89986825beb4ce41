"""An append-only keyed table: id buckets, committed runs, a manifest, compaction.

Layout: ``<path>/run=<run>/bucket=<b>/*.parquet`` and ``<path>/_manifest/<sequence>.json``.

* A row lies in the bucket of its id's hash, so a look-up by ids reads only the
  buckets that the ids fall in, and of those only the id column.
* An append is one run, named by its caller or a random name, never by a clock.
  It counts once the manifest that lists it is there; the manifest names the live
  runs with their rows per bucket. Manifests are numbered and never overwritten:
  of two writers that commit at once one fails and is told so. A run that was
  committed before (a replayed micro-batch) adds nothing; files of a run that
  never got that far are not read and are overwritten by its next attempt.
* ``compact`` joins the smallest runs, each bucket into one file, until the runs'
  sizes fall off geometrically, so a row is rewritten a logarithmic number of
  times. The runs that it replaced are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import remove_folder

BUCKETS = 64
_SEED = 17


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(sequence, file) of all manifests, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifest")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where)]
    return sorted((int(p.getName()[:-5]), p.toString()) for p in found if p.getName().endswith(".json"))


def _text(spark: SparkSession, file: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class KeyedStore:
    """A store under ``path`` with rows of ``schema``, keyed by the long column ``id``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        found = _manifests(spark, self.path)
        self.sequence = found[-1][0] if found else 0
        state = json.loads(_text(spark, found[-1][1])) if found else {"buckets": buckets, "runs": []}
        self.buckets: int = state["buckets"]
        self.runs: list[dict] = state["runs"]

    def bucket(self, key: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(F.lit(_SEED), F.col(key) if isinstance(key, str) else key),
                      F.lit(self.buckets)).cast("int")

    def _scan(self, runs: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/run={r}" for r in runs]
        fields = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()),
                               T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", self.path).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows of the live runs."""
        return self._scan(r["run"] for r in self.runs if r["rows"]).select(*self.schema.names)

    def rows_of(self, run: str) -> DataFrame:
        """The rows that one live run added."""
        return self._scan(r["run"] for r in self.runs if r["run"] == run and r["rows"]).select(*self.schema.names)

    def touched(self, keys: DataFrame, key: str = "id") -> list[int]:
        """Buckets that some key falls in: one small row a task, at most ``buckets`` values here."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect() if r[0] is not None)

    def part(self, buckets: list[int], columns: list[str], not_from: str | None = None) -> DataFrame:
        """Columns of the rows in some buckets, without the runs of one writer (``not_from``)."""
        wanted = {str(b) for b in buckets}
        runs = [r["run"] for r in self.runs
                if wanted & r["by_bucket"].keys() and (not_from is None or r.get("origin") != not_from)]
        return self._scan(runs).filter(F.col("bucket").isin(buckets)).select(*columns)

    def missing(self, rows: DataFrame, not_from: str | None = None) -> DataFrame:
        """The rows whose id is not stored yet: an anti-join with the ids of the touched buckets only."""
        if not [r for r in self.runs if r["rows"] and (not_from is None or r.get("origin") != not_from)]:
            return rows
        stored = self.part(self.touched(rows), ["id"], not_from)
        return rows.join(stored, "id", "left_anti")

    def append(self, rows: DataFrame, run: str | None = None, origin: str | None = None) -> str:
        """Commit ``rows`` as one run; returns its name. A run that is live already stays as it is."""
        run = run or uuid.uuid4().hex
        if any(r["run"] == run or run in r.get("joined", ()) for r in self.runs):
            return run
        by_bucket = self._write(rows.select(*self.schema.names), run)
        self._commit([*self.runs, {"run": run, "rows": sum(by_bucket.values()), "by_bucket": by_bucket,
                                   "origin": origin}])
        return run

    def _write(self, rows: DataFrame, run: str) -> dict[str, int]:
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.path}/run={run}"))
        done = self._scan([run]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        return {str(r.bucket): r.n for r in done}

    def _commit(self, runs: list[dict]) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{self.sequence + 1:010d}.json")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(target, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        finally:
            out.close()
        self.sequence, self.runs = self.sequence + 1, runs

    def compact(self, factor: int = 4) -> bool:
        """Join the newest runs that together reach 1/``factor`` of the next larger one; True if any were."""
        by_size = sorted(self.runs, key=lambda r: r["rows"])
        take, total = 0, 0
        for i, r in enumerate(by_size):
            if i >= 1 and total * factor < r["rows"]:
                break
            take, total = i + 1, total + r["rows"]
        if take < 2:
            return False
        old = by_size[:take]
        run = uuid.uuid4().hex
        by_bucket = self._write(self._scan(r["run"] for r in old if r["rows"]).select(*self.schema.names), run)
        origins = {r.get("origin") for r in old}
        joined = [n for r in old for n in (r["run"], *r.get("joined", ()))]
        self._commit([*by_size[take:], {"run": run, "rows": total, "by_bucket": by_bucket, "joined": joined,
                                        "origin": origins.pop() if len(origins) == 1 else None}])
        return True

    def vacuum(self) -> list[str]:
        """Remove the files of runs that no longer count; no reader may still hold an older state."""
        live = {r["run"] for r in self.runs}
        gone = sorted({n for r in self.runs for n in r.get("joined", ()) if n not in live})
        for name in gone:
            remove_folder(self.spark, f"{self.path}/run={name}")
        return gone
