"""Sources and sinks: report/pair/label files, the vector table, landed pages.

Every reader takes a fixed ``StructType`` (no inference). ``land_reports`` reads
multi-line CSV with many tasks per file and converts it to Parquet once; later
jobs read the Parquet copy with column pruning and predicate pushdown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.functions.extraction import FIELD_DEFINITIONS, FIELD_ENUMS
from tessera.sources.quoted import read_quoted_csv
from tessera.sources.store import KeyedStore

REPORT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("creation_time", T.TimestampType()),
    T.StructField("dupe_of", T.LongType()),
    T.StructField("role", T.StringType()),
])
PAIR_SCHEMA = T.StructType([T.StructField("dup_id", T.LongType()), T.StructField("master_id", T.LongType())])
LABEL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("component", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("llm_area", T.StringType()),
    T.StructField("llm_severity", T.StringType()),
    T.StructField("llm_kind", T.StringType()),
    T.StructField("human_good", T.StringType()),
])
VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("text", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("component", T.StringType()),
                                        T.StructField("summary", T.StringType())])),
    # content hash of the stored text and the ingest version (append-only store)
    T.StructField("text_hash", T.LongType()),
    T.StructField("version", T.LongType()),
])
# Fields requested per report from the tracker API (fixed values).
PAGE_FIELDS = ("id", "summary", "component", "product", "severity", "resolution", "creation_time", "dupe_of")
PAGE_SCHEMA = T.StructType([T.StructField("bugs", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("summary", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("product", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("resolution", T.StringType()),
    T.StructField("creation_time", T.StringType()), T.StructField("dupe_of", T.LongType())])))])
COMMENT_PAGE_SCHEMA = T.StructType([T.StructField("bugs", T.MapType(T.StringType(), T.StructType([
    T.StructField("comments", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])))])

_CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv(spark: SparkSession, path: str, schema: T.StructType, **opts) -> DataFrame:
    o = dict(_CSV_OPTIONS)
    o.update({k: str(v) for k, v in opts.items()})
    return spark.read.options(**o).schema(schema).csv(path)


def read_reports(spark: SparkSession, path: str, null_tokens: Iterable[str] = (),
                 parallel: bool = False) -> DataFrame:
    """Report table from multi-line quoted CSV.

    Empty text fields read as '' (never the text ``nan``); only the listed
    ``null_tokens`` (e.g. ``NA``) become null. With ``parallel`` a file is read
    by many tasks (``read_quoted_csv``), for files that keep to RFC 4180.
    """
    df = read_quoted_csv(spark, path, REPORT_SCHEMA, **_CSV_OPTIONS) if parallel else _csv(spark, path, REPORT_SCHEMA)
    toks = list(null_tokens)
    for c in ("summary", "description", "component", "product", "severity", "resolution"):
        v = F.coalesce(F.col(c), F.lit(""))
        df = df.withColumn(c, F.when(v.isin(toks), F.lit(None)).otherwise(v) if toks else v)
    return df


def land_reports(spark: SparkSession, csv_path: str, parquet_path: str, parallel: bool = True) -> DataFrame:
    """Convert the CSV once to Parquet and return the Parquet scan.

    ``parallel=False`` reads each file in one task, for files whose quotes do not keep to RFC 4180.
    """
    read_reports(spark, csv_path, parallel=parallel).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair table."""
    return _csv(spark, path, PAIR_SCHEMA)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human label table (S7); ``human_good`` kept as text until ``usable_labels``."""
    return _csv(spark, path, LABEL_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink that round-trips multi-line text (RFC 4180 quoting)."""
    (df.write.mode("overwrite").options(**{k: v for k, v in _CSV_OPTIONS.items() if k != "multiLine"})
     .option("quoteAll", "false").option("emptyValue", '""').csv(path))


def write_reports(df: DataFrame, path: str) -> None:
    """Merged report table with the ten fixed columns, missing values empty."""
    cols = []
    for f in REPORT_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name) if f.dataType == T.StringType()
                    else c.cast(f.dataType).alias(f.name))
    write_csv(df.select(*cols), path)


def write_pairs(df: DataFrame, path: str) -> None:
    """Usable pairs."""
    write_csv(df.select(F.col("dup_id").cast("long"), F.col("master_id").cast("long")), path)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a vector store, or of a plain Parquet table of the same schema."""
    store = KeyedStore(spark, path, VECTOR_SCHEMA)
    return store.read() if store.sequence else spark.read.schema(VECTOR_SCHEMA).parquet(path)


def latest_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, latest version per id.

    The store is append-only: re-embedded texts (``reembed_changed``) add a
    newer version. The newest version per id comes from an aggregate over
    ``(id, version)`` only (partial per task); the rows are then picked by a
    join on ``(id, version)``, so vectors and texts never shuffle for the
    aggregate and a frequently re-embedded id does not skew the join.
    """
    df = stored_vectors(spark, path).withColumn("version", F.coalesce(F.col("version"), F.lit(0)))
    newest = df.groupBy("id").agg(F.max("version").alias("version"))
    return df.join(newest, ["id", "version"], "left_semi")


def read_vectors(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """Full vector scan, pruned to id and embedding (S3); ``latest`` resolves versions."""
    if latest:
        return latest_vectors(spark, path).select("id", "embedding")
    return stored_vectors(spark, path).select("id", "embedding")


def vectors_for(ids: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Vectors for an id list; absent ids are skipped."""
    return vectors.join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "inner")


def stored_ids(vectors: DataFrame) -> DataFrame:
    """Size of the vector table and its distinct ids."""
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.countDistinct("id").alias("n_ids"))


def with_vectors(reports: DataFrame, vectors: DataFrame) -> DataFrame:
    """Reports aligned with their vectors by id, not by position."""
    return reports.join(vectors, "id", "inner")


def unembedded(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Reports with no stored vector yet (J1): a ``left_anti`` join on id."""
    return corpus.join(vectors.select("id"), "id", "left_anti")


EmbedFn = Callable[[list[str]], list[list[float]]]


def _embed_batches(fn: EmbedFn, batch: int):
    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                vecs = fn(part["text"].tolist())
                yield pd.DataFrame({
                    "id": part["id"].astype("int64").values,
                    "embedding": [list(map(float, v)) for v in vecs],
                    "text": part["text"].values,
                    "meta": [{"component": c, "summary": s} for c, s in
                             zip(part["component"].values, part["summary"].values)],
                    "text_hash": part["text_hash"].astype("int64").values,
                    "version": part["version"].astype("int64").values,
                })
    return run


def append_vectors(corpus: DataFrame, vectors_path: str, embed_fn: EmbedFn | None = None,
                   batch: int = 500, reembed_changed: bool = False, summary_chars: int | None = None,
                   run: str | None = None, origin: str | None = None) -> DataFrame:
    """Embed only reports not yet stored and append them.

    ``corpus`` needs ``id, component, summary`` and either ``text`` or
    ``description``. The store is a ``KeyedStore``: the anti-join against the
    stored ids reads only the buckets that the corpus ids fall in, runs first,
    on the raw rows, and text is composed (P1) only for the new ones, so an
    append costs in proportion to what is new. With ``reembed_changed`` a row is
    also re-embedded when the ``xxhash64`` of its text differs from the latest
    stored one; the new version is appended and ``latest_vectors`` reads the
    newest per id. A version is the number of its commit. Text and metadata are
    stored and embedded whole; ``summary_chars`` (200 in the reference's store)
    cuts the metadata summary. With no ``embed_fn`` the built-in stateless
    hashed vectors are used, so every append lands in the same vector space.

    ``run`` names the append, and one that was committed under that name adds
    nothing; a writer that keeps track of its own ids names itself as ``origin``
    and is compared with the others' rows only. Returns the appended rows as
    read back from the store; the model is not called again.
    """
    from tessera.operators.stats import with_text
    store = KeyedStore(corpus.sparkSession, vectors_path, VECTOR_SCHEMA)
    if reembed_changed:
        rows = corpus if "text" in corpus.columns else with_text(corpus)
        rows = rows.withColumn("_h", F.xxhash64("text"))
        # latest stored hash per id: an aggregate over three narrow columns of the touched buckets
        known = (store.part(store.touched(rows), ["id", "text_hash", "version"]).groupBy("id")
                 .agg(F.max_by("text_hash", F.coalesce(F.col("version"), F.lit(0))).alias("_old")))
        new_rows = (rows.join(known, "id", "left")
                    .filter(F.col("_old").isNull() | (F.col("_old") != F.col("_h"))).drop("_old", "_h"))
    else:
        new_rows = store.missing(corpus, origin)
        if "text" not in new_rows.columns:
            new_rows = with_text(new_rows)
    summary = F.coalesce(F.col("summary"), F.lit(""))
    if summary_chars is not None:
        summary = TX.clip(summary, summary_chars)
    todo = new_rows.select(F.col("id").cast("long").alias("id"), F.coalesce("component", F.lit("")).alias("component"),
                           summary.alias("summary"), F.col("text"), F.xxhash64("text").alias("text_hash"),
                           F.lit(store.sequence + 1).cast("long").alias("version"))
    if embed_fn is None:
        from tessera.operators.embed import hashed_tf
        new = hashed_tf(todo).select(
            "id", "embedding", "text", F.struct(F.col("component"), F.col("summary")).alias("meta"),
            "text_hash", "version")
    else:
        new = todo.mapInPandas(_embed_batches(embed_fn, batch), VECTOR_SCHEMA)
    return store.rows_of(store.append(new, run, origin))


def field_catalog(spark: SparkSession) -> DataFrame:
    """Field definitions and allowed values as one dimension table."""
    rows = [(f, d, FIELD_ENUMS.get(f)) for f, d in FIELD_DEFINITIONS.items()]
    return spark.createDataFrame(rows, "field string, definition string, allowed array<string>")


def taxonomy(reports: DataFrame, col: str = "component") -> DataFrame:
    """Distinct component names, nulls dropped, sorted."""
    return reports.select(F.col(col).cast("string").alias("component")).dropna().distinct().orderBy("component")


def explode_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed search/fetch pages ``{"bugs": [...]}`` -> one row per report."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    return pages.select(F.explode("bugs").alias("b")).select("b.*")


def first_comment(spark: SparkSession, path: str, chars: int | None = None) -> DataFrame:
    """Landed comment pages -> (id, first comment text).

    The whole comment by default; ``chars`` (4,000 in the reference's cache)
    cuts it. A page with no comments gives ''. So does one that cannot be read;
    its id is then the first number of the landed file's name (null without one).
    """
    pages = spark.read.schema(COMMENT_PAGE_SCHEMA).json(path)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1)
    e = pages.select(named.alias("file_id"), F.explode_outer("bugs").alias("id", "v"))
    txt = F.try_element_at(F.col("v.comments"), F.lit(1))["text"]
    txt = txt if chars is None else TX.clip(txt, chars)
    return e.select(F.coalesce(F.col("id"), F.col("file_id")).try_cast("long").alias("id"),
                    F.coalesce(txt, F.lit("")).alias("text"))


def missing_descriptions(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids whose description is not cached yet."""
    return ids.join(cache.select("id"), "id", "left_anti")


def annotation_template(extractions: DataFrame, chars: int = TX.DESCRIPTION_LOOKUP_CHARS) -> DataFrame:
    """Accepted extractions as a blank annotation sheet, 7 columns + human_good."""
    return (extractions.filter(F.col("ok"))
            .select("id", "component", "summary", TX.clip(F.col("description"), chars).alias("description"),
                    "llm_area", "llm_severity", "llm_kind", F.lit(None).cast("int").alias("human_good")))
