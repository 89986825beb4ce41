"""Merging landed report sources and the id-set joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Role priority when one id arrives from several sources
# (a duplicate overrides a master, a master overrides a plain corpus row).
ROLE_PRIORITY = {"dup": 0, "master": 1, "corpus": 2}


def prefer_role(df: DataFrame, id_col: str = "id", role_col: str = "role") -> DataFrame:
    """One row per id, the one whose role has the highest priority.

    The winner is chosen on (id, priority, row hash), a hash aggregate over two
    longs that is partial per task, so an id repeated across a third of the rows
    costs one small row per task in its shuffle. The winners' rows are then
    fetched by a join on the same two; equal rows, which share a hash, become
    one where they lie. Ties between equal roles resolve the same
    way every run.
    """
    prio = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv]),
                            F.col(role_col))
    others = [F.col(c) for c in df.columns if c != id_col]
    # one long: the priority in the upper bits, 61 bits of the row's hash below it
    key = (F.shiftleft(F.coalesce(prio, F.lit(len(ROLE_PRIORITY))).cast("long"), 61)
           .bitwiseOR(F.shiftrightunsigned(F.xxhash64(*others), 3)))
    rows = df.withColumn("_k", key)
    best = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min("_k").alias("_best"))
    won = rows.join(best, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_best")), "left_semi")
    return won.distinct().select(*df.columns)


def merge_sources(masters: DataFrame, extra: DataFrame, dups: DataFrame) -> DataFrame:
    """Union of three landed sources, unique by id with its role."""
    tagged = (masters.withColumn("role", F.lit("master"))
              .unionByName(extra.withColumn("role", F.lit("corpus")))
              .unionByName(dups.withColumn("role", F.lit("dup"))))
    return prefer_role(tagged)


def labelled_dups(df: DataFrame, col: str = "dupe_of") -> DataFrame:
    """Rows whose ``dupe_of`` is set, cast to an id.

    Digits are read as LONG, exact for every id; only other forms such as
    ``12.0`` go through DOUBLE.
    """
    v = F.col(col).cast("string")
    return (df.filter(v.isNotNull() & (F.trim(v) != ""))
            .withColumn(col, F.coalesce(F.trim(v).try_cast("long"), v.try_cast("double").try_cast("long"))))


def distinct_masters(dups: DataFrame, col: str = "dupe_of") -> DataFrame:
    """Distinct master ids named by duplicates."""
    return dups.select(F.col(col).cast("long").alias("master_id")).filter(
        F.col("master_id").isNotNull()).distinct()


def masters_for(dups: DataFrame, corpus: DataFrame, col: str = "dupe_of") -> DataFrame:
    """Corpus rows that some duplicate points to."""
    m = distinct_masters(dups, col)
    return corpus.join(m, F.col("id") == F.col("master_id"), "left_semi")


def usable_pairs(dups: DataFrame, corpus: DataFrame, col: str = "dupe_of") -> DataFrame:
    """(dup_id, master_id) pairs whose master is in the corpus."""
    p = dups.select(F.col("id").cast("long").alias("dup_id"), F.col(col).cast("long").alias("master_id"))
    return p.join(corpus.select(F.col("id").alias("master_id")), "master_id", "left_semi").select(
        "dup_id", "master_id")


def attach_descriptions(df: DataFrame, desc: DataFrame, text_col: str = "text") -> DataFrame:
    """Left join of cached descriptions, '' when absent."""
    d = desc.select(F.col("id").alias("_did"), F.col(text_col).alias("_desc"))
    out = df.join(d, F.col("id") == F.col("_did"), "left").drop("_did")
    if "description" in df.columns:
        out = out.drop("description")
    return out.withColumn("description", F.coalesce(F.col("_desc"), F.lit(""))).drop("_desc")


def year_range(df: DataFrame, col: str = "creation_time") -> DataFrame:
    """First and last creation year."""
    from tessera.functions.text import year_of
    y = year_of(F.col(col))
    return df.agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))
