"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Local session for tests and the bench (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle width when the
    session exposes no SparkContext, e.g. a remote session)."""
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # noqa: BLE001
        try:
            return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        except (TypeError, ValueError):
            return 8


def has_context(spark: SparkSession) -> bool:
    try:
        spark.sparkContext  # noqa: B018
        return True
    except Exception:  # noqa: BLE001
        return False


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers (what ``--py-files`` does).

    The package's ``.py`` files are zipped once per application and added
    with ``addPyFile``; Spark distributes the zip to every executor, so the
    Arrow UDF closures can import their helpers wherever the driver runs.
    """
    pkg = os.path.dirname(os.path.abspath(__file__))
    if has_context(spark):
        sc = spark.sparkContext
        key = sc.applicationId
    else:
        key = "remote"
    if key in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("tessera", os.path.relpath(full, pkg)))
    if key == "remote":
        try:
            spark.addArtifacts(path, pyfile=True)
        except Exception:  # noqa: BLE001 - nothing to ship to
            return
    else:
        sc.addPyFile(path)
    _SHIPPED.add(key)


def keep_last_json_key(spark: SparkSession) -> None:
    """Let JSON objects that repeat a key keep its last value, unless the session has set that itself."""
    name = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in ``spark.checkpoint.dir``.

    A folder set on the context (``setCheckpointDir``) serves as well. There is
    no fallback: a machine-local folder would not be seen by other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext if has_context(spark) else None
    current = context.getCheckpointDir() if context else None
    if not configured and not current:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if configured and context and not current:
        context.setCheckpointDir(configured)
    return configured or current


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store (through Hadoop's file systems)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    """One small text file in the shared store (through Hadoop's file systems)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
