"""Source-merge and id-set join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import testdata as td
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import ingest as IN


_SOURCES_SQL = """
    tagged AS (
      SELECT doc_id AS id, 'master' AS role FROM documents WHERE lang IN ('en', 'de')
      UNION ALL SELECT doc_id, 'corpus' FROM documents WHERE lang IN ('en', 'fr', 'es')
      UNION ALL SELECT id, 'dup' FROM reports WHERE role = 'dup')"""


def _sources(spark, sf):
    d = td.table(spark, sf, "documents")
    masters = d.filter(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("id"))
    extra = d.filter(F.col("lang").isin("en", "fr", "es")).select(F.col("doc_id").alias("id"))
    dups = td.reports(spark, sf, with_role=True).filter(F.col("role") == "dup").select("id")
    return masters, extra, dups


@register("merge_sources", with_views(f"""
    , {_SOURCES_SQL.strip()}
    SELECT id, role FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY
               CASE role WHEN 'dup' THEN 0 WHEN 'master' THEN 1 ELSE 2 END) AS rn FROM tagged)
    WHERE rn = 1""", "reports"))
def q_merge_sources(spark, sf):
    """Three overlapping sources merged, unique by id, dup > master > corpus."""
    return IN.merge_sources(*_sources(spark, sf)).select("id", "role")


_DUPS_SQL = "SELECT g.doc_id AS id, g.master_id AS dupe_of FROM text_groups g WHERE g.doc_id <> g.master_id"


def _dups(spark, sf):
    return td.text_pairs(spark, sf).select(F.col("dup_id").alias("id"), F.col("master_id").alias("dupe_of"))


@register("labelled_dups", with_views("""
    SELECT r.id, CASE WHEN r.id % 3 = 0 THEN 9007199254740993 + r.id ELSE CAST(g.master_id AS BIGINT) END AS dupe_of
    FROM reports r JOIN text_groups g ON r.id = g.doc_id
    WHERE r.role = 'dup'""", "reports"))
def q_labelled_dups(spark, sf):
    """Rows whose dupe_of is set, as ids; texts past 2**53, written as ``12.0`` and plain."""
    r = td.reports(spark, sf, with_role=True)
    form = (F.when(F.col("dup_id") % 3 == 0, (F.col("dup_id") + 9007199254740993).cast("string"))
            .when(F.col("dup_id") % 3 == 1, F.concat(F.col("master_id").cast("string"), F.lit(".0")))
            .otherwise(F.col("master_id").cast("string")))
    g = td.text_pairs(spark, sf).select(F.col("dup_id").alias("id"), form.alias("dupe_of"))
    rows = r.join(g, "id", "left")
    return IN.labelled_dups(rows).select("id", "dupe_of")


@register("distinct_masters", with_views("SELECT DISTINCT master_id FROM text_pairs", "text_pairs"))
def q_distinct_masters(spark, sf):
    """Distinct master ids named by duplicates."""
    return IN.distinct_masters(_dups(spark, sf))


@register("masters_for", with_views("""
    SELECT id, component FROM reports WHERE id IN (SELECT master_id FROM text_pairs)""", "reports", "text_pairs"))
def q_masters_for(spark, sf):
    """Corpus rows that a duplicate points to."""
    return IN.masters_for(_dups(spark, sf), td.reports(spark, sf)).select("id", "component")


@register("usable_pairs", with_views("""
    SELECT p.dup_id, p.master_id FROM text_pairs p
    WHERE p.master_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de'))""", "text_pairs"))
def q_usable_pairs(spark, sf):
    """Pairs whose master is in the (English/German) corpus slice."""
    corpus = td.table(spark, sf, "documents").filter(F.col("lang").isin("en", "de")).select(
        F.col("doc_id").alias("id"))
    return IN.usable_pairs(_dups(spark, sf), corpus)


@register("attach_descriptions", with_views("""
    SELECT v.id, coalesce(r.description, '') AS description
    FROM vectors v LEFT JOIN reports r ON v.id = r.id""", "vectors", "reports"))
def q_attach_descriptions(spark, sf):
    """Descriptions attached by id with '' when absent."""
    desc = td.reports(spark, sf).select("id", F.col("description").alias("text"))
    return IN.attach_descriptions(td.vectors(spark, sf).select("id"), desc)


@register("unembedded", """
    SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def q_unembedded(spark, sf):
    """Documents without a stored vector (left anti join)."""
    from tessera.sources.readers import unembedded
    ids = td.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return unembedded(ids, td.vectors(spark, sf))


@register("with_vectors", with_views("""
    SELECT r.id, r.component, v.label, CAST(len(v.embedding) AS INTEGER) AS dims
    FROM reports r JOIN vectors v ON r.id = v.id""", "reports", "vectors"))
def q_with_vectors(spark, sf):
    """Reports aligned with their vectors by id."""
    from tessera.sources.readers import with_vectors
    j = with_vectors(td.reports(spark, sf), td.vectors(spark, sf))
    return j.select("id", "component", "label", F.size("embedding").alias("dims"))


@register("vectors_for", """
    SELECT l.doc_id AS id, e.embedding FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id""")
def q_vectors_for(spark, sf):
    """Batch vector get by id list; absent ids skipped."""
    from tessera.sources.readers import vectors_for
    ids = td.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return vectors_for(ids, td.vectors(spark, sf)).select("id", "embedding")


@register("stored_ids", """
    SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids FROM embeddings""")
def q_stored_ids(spark, sf):
    """Size of the vector table and its distinct ids."""
    from tessera.sources.readers import stored_ids
    return stored_ids(td.vectors(spark, sf))
