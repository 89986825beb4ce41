"""Source, sink and streaming round-trip queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import checkpoint_dir, cut_lineage, remove_folder, write_small_file
from tessera.sources import readers as RD


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-scratch/{name}-{uuid.uuid4().hex}"


def read_then_remove(spark, df, *paths: str):
    """The result cut from the scratch copies it was read from, and those removed.

    The cut is a checkpoint, which Spark's cleaner removes with its DataFrame.
    """
    out = cut_lineage(df)
    for path in paths:
        remove_folder(spark, path)
    return out


_REPORTS_SQL = with_views("""
    SELECT r.id, summary, description, component, lang AS product, 'S' || r.id % 5 AS severity, '' AS resolution,
           TIMESTAMP '2020-12-31 20:00:00' + to_seconds(r.id) AS creation_time,
           CASE WHEN r.role = 'dup' THEN 9007199254740993 + g.master_id END AS dupe_of, r.role
    FROM reports r JOIN text_groups g ON r.id = g.doc_id""", "reports")


def _written_reports(spark, sf, path):
    """All ten report columns written as multi-line CSV."""
    masters = td.text_pairs(spark, sf).select(F.col("dup_id").alias("id"), "master_id")
    rows = td.reports(spark, sf, with_role=True).join(masters, "id", "left").select(
        "id", "summary", "description", "component", F.col("lang").alias("product"),
        F.concat(F.lit("S"), F.col("id") % 5).alias("severity"),
        F.expr("timestamp_seconds(1609444800 + id)").alias("creation_time"),
        (F.col("master_id") + 9007199254740993).alias("dupe_of"), "role")
    RD.write_reports(rows, path)


@register("read_reports_csv", _REPORTS_SQL)
def q_read_reports_csv(spark, sf):
    """All ten report columns written as multi-line CSV and read back with the fixed schema."""
    path = scratch(spark, "reports-csv")
    _written_reports(spark, sf, path)
    return read_then_remove(spark, RD.read_reports(spark, path), path)


@register("land_reports_csv", _REPORTS_SQL)
def q_land_reports_csv(spark, sf):
    """The same CSV read by many tasks per file, landed as Parquet and scanned from there."""
    path, landed = scratch(spark, "reports-csv"), scratch(spark, "reports-landed")
    _written_reports(spark, sf, path)
    rows = RD.land_reports(spark, path, landed)
    remove_folder(spark, path)  # landed, so the CSV is not read again
    return read_then_remove(spark, rows, landed)


@register("read_pairs_csv", with_views("SELECT dup_id, master_id FROM text_pairs", "text_pairs"))
def q_read_pairs_csv(spark, sf):
    """Usable pairs written and read back."""
    path = scratch(spark, "pairs-csv")
    RD.write_pairs(td.text_pairs(spark, sf), path)
    return read_then_remove(spark, RD.read_pairs(spark, path), path)


@register("read_labels_csv", with_views("""
    SELECT r.id, CAST(l.quality AS INTEGER) AS human_good
    FROM labels l JOIN reports r ON r.id = l.doc_id""", "reports"))
def q_read_labels_csv(spark, sf):
    """A label sheet written as CSV, read back, usable labels kept."""
    from tessera.operators.agreement import usable_labels
    sheet = (td.reports(spark, sf).join(td.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("human_good")), "id")
        .select("id", "component", "summary", "description",
                F.lit("").alias("llm_area"), F.lit("").alias("llm_severity"), F.lit("").alias("llm_kind"),
                "human_good"))
    path = scratch(spark, "labels-csv")
    RD.write_csv(sheet, path)
    return read_then_remove(spark, usable_labels(RD.read_labels(spark, path)).select("id", "human_good"), path)


@register("explode_pages", with_views("""
    SELECT id, summary, component, '' AS product, severity, status AS resolution,
           strftime(creation_time, '%Y-%m-%dT%H:%M:%SZ') AS creation_time FROM severity_reports""",
                                      "severity_reports"))
def q_explode_pages(spark, sf):
    """Landed API pages ({"bugs": [...]}, 250 per page) exploded to rows."""
    r = td.severity_reports(spark, sf).select(
        "id", "summary", "component", F.lit("").alias("product"), "severity", F.col("status").alias("resolution"),
        F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time"),
        F.lit(None).cast("long").alias("dupe_of"))
    pages = (r.groupBy(F.floor(F.col("id") / 250).alias("_page"))
             .agg(F.collect_list(F.struct(*[c for c in r.columns])).alias("bugs")))
    path = scratch(spark, "pages-json")
    pages.select("bugs").write.mode("overwrite").json(path)
    return read_then_remove(spark, RD.explode_pages(spark, path).drop("dupe_of"), path)


def _land_comments(spark, sf) -> str:
    conv = td.table(spark, sf, "conversations")
    per = conv.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                                  lambda s: F.struct(s["text"].alias("text"))).alias("comments"))
    page = per.select(F.create_map(F.col("conv_id").cast("string"), F.struct("comments")).alias("bugs"))
    path = scratch(spark, "comments-json")
    page.write.mode("overwrite").json(path)
    # a page that cannot be read, in a file named by its id
    write_small_file(spark, f"{path}/{UNREADABLE_ID}.json", "<html>service unavailable")
    return path


# Fixed value: the id of the unreadable comment page.
UNREADABLE_ID = 999999999


@register("first_comment", """
    SELECT conv_id AS id, text FROM conversations WHERE turn = 0
    UNION ALL SELECT 999999999, ''""")
def q_first_comment(spark, sf):
    """First comment of each landed comment page as the description, '' for the unreadable one."""
    path = _land_comments(spark, sf)
    return read_then_remove(spark, RD.first_comment(spark, path), path)


@register("missing_descriptions", """
    SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT DISTINCT conv_id FROM conversations)""")
def q_missing_descriptions(spark, sf):
    """Report ids whose description is not in the landed cache yet."""
    path = _land_comments(spark, sf)
    ids = td.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return read_then_remove(spark, RD.missing_descriptions(ids, RD.first_comment(spark, path)), path)


@register("append_vectors", "SELECT doc_id AS id, 256 AS dims FROM documents")
def q_append_vectors(spark, sf):
    """Vectors appended twice from the same reports; each id stored once."""
    path = scratch(spark, "vectors")
    corpus = td.reports(spark, sf).select("id", "component", "summary", "description")
    RD.append_vectors(corpus, path)
    RD.append_vectors(corpus, path)
    return read_then_remove(spark, RD.read_vectors(spark, path).select("id", F.size("embedding").alias("dims")), path)


@register("compact_store", """
    SELECT doc_id AS id, 256 AS dims, CAST(2 - doc_id % 2 AS BIGINT) AS version FROM documents""")
def q_compact_store(spark, sf):
    """Odd ids, all ids and all again appended as three runs; the runs compacted, the old ones vacuumed."""
    path = scratch(spark, "store")
    corpus = td.reports(spark, sf).select("id", "component", "summary", "description")
    for part in (corpus.filter("id % 2 = 1"), corpus, corpus):
        RD.append_vectors(part, path)
    store = RD.KeyedStore(spark, path, RD.VECTOR_SCHEMA)
    store.compact()
    store.vacuum()
    out = RD.stored_vectors(spark, path).select("id", F.size("embedding").alias("dims"), "version")
    return read_then_remove(spark, out, path)


@register("ingest_stream", "SELECT doc_id AS id, 256 AS dims FROM documents")
def q_ingest_stream(spark, sf):
    """Report files landed twice, streamed with availableNow, each id stored once."""
    from tessera.streaming.ingest import ingest_stream, read_store
    src = scratch(spark, "landing")
    store = scratch(spark, "store")
    rep = td.reports(spark, sf, with_role=True).select(*[F.col(f.name) if f.name in ("id", "summary", "description",
                                                                      "component", "role")
                                         else F.lit(None).cast(f.dataType).alias(f.name)
                                         for f in RD.REPORT_SCHEMA.fields])
    rep.write.mode("append").parquet(src + "/drop1")
    rep.write.mode("append").parquet(src + "/drop2")
    progress = scratch(spark, "ingest-ckpt")
    q = ingest_stream(spark, src + "/*", store, checkpoint=progress)
    q.awaitTermination()
    return read_then_remove(spark, read_store(spark, store).select("id", F.size("embedding").alias("dims")),
                            src, store, progress)


@register("embed_documents")
def q_embed_documents(spark, sf):
    """hashed TF-IDF vectors for every whole document text."""
    from tessera.operators.embed import embed
    d = td.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return embed(d).select("id", "embedding")
