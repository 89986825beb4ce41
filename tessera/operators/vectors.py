"""Vector table operators: exact k-nearest join, neighbour enrichment, flags.

``knn_join`` is the exact cosine top-k per query, on a grid of (query block,
corpus block) cells that Spark's shuffle deals out: no query vector passes the
driver and the plan is the same for every size. The approximate search over a
stored index is in ``tessera.operators.ivf``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.topk import top_k, vector_matrix
from tessera.session import parallelism

KNN_SCHEMA = "qid long, rank int, id long, sim double"
_KNN = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())])
_KNN_DDL = "qid long, id long, sim double"
# Bytes of the vectors of one block of queries or of corpus rows, counted in float64; a task holds them in float32.
DEFAULT_QUERY_BLOCK_BYTES = 64 << 20
DEFAULT_CORPUS_BLOCK_BYTES = 64 << 20
# Queries worth a block of their own when blocks are made for the sake of parallelism.
MIN_BLOCK_QUERIES = 64


def vector_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(_id, _v)`` of the rows that have both; the others cannot take part in a similarity search."""
    return df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v")).dropna()


def best_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k best ``(qid, id, sim)`` per query, ranked; tasks pre-cut to k before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("id").asc())
    return (pairs.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            .select("qid", "rank", "id", "sim"))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 10, *, query_id: str = "id",
             corpus_id: str = "id", vector: str = "embedding", exclude_self: bool = True,
             query_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES,
             corpus_block_bytes: int = DEFAULT_CORPUS_BLOCK_BYTES) -> DataFrame:
    """Exact k-nearest join by cosine similarity.

    Returns ``(qid, rank, id, sim)``: for every query row with an id and a
    vector, the ``k`` corpus rows of highest cosine similarity, ordered by
    similarity then id. The query's own id is removed before ranking, so ``k``
    rows are returned whenever the corpus holds ``k`` other rows; a zero vector
    is at similarity 0 to everything; a shorter vector is padded with zeros.

    Both sides are cut by a hash of the id into blocks of bounded bytes, and
    every block of queries meets every block of the corpus in one cell. A row
    is shuffled once per block of the other side, so the traffic is rows times
    rows over block size, as the work is; a cell sends on at most ``k`` rows per
    query. Small inputs are cut along the queries, so that every core has some
    and a query's whole answer comes from one cell.
    """
    q, c = vector_rows(queries, query_id, vector), vector_rows(corpus, corpus_id, vector)
    sizes = [F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("d")]
    (_, nq, dq), (_, nc, dc) = sorted(q.agg(F.lit(0).alias("side"), *sizes)
                                      .unionAll(c.agg(F.lit(1).alias("side"), *sizes)).collect())
    width, spark = max(1, dq, dc), q.sparkSession
    c_blocks = max(1, -(-nc * width * 8 // corpus_block_bytes))
    q_blocks = max(1, -(-nq * width * 8 // query_block_bytes),
                   min(-(-2 * parallelism(spark) // c_blocks), nq // MIN_BLOCK_QUERIES))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, min(4 * c_blocks * q_blocks, 2 * shuffle))

    def block(n: int):
        return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell = ["_qb", "_cb"]
    left = q.withColumns({"_qb": block(q_blocks), "_cb": every(c_blocks)}).repartition(parts, *cell)
    right = (c.select(F.col("_id").alias("_id"), F.col("_v").alias("_v"))  # names of its own: often the same table
             .withColumns({"_cb": block(c_blocks), "_qb": every(q_blocks)}).repartition(parts, *cell))

    def search(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not len(qt) or not len(ct):
            return _KNN.empty_table()
        qids = qt["_id"].to_numpy()
        i, ids, sims = top_k(qids, vector_matrix(qt["_v"], width, np.float32), ct["_id"].to_numpy(),
                             vector_matrix(ct["_v"], width, np.float32), k, exclude_self)
        return pa.table([qids[i], ids, sims], schema=_KNN)

    return best_k(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, _KNN_DDL), k)


def enrich_neighbours(nn: DataFrame, reports: DataFrame, summary_chars: int = T.SUMMARY_NEIGHBOUR_CHARS) -> DataFrame:
    """Neighbours with component and clipped summary; unknown ids dropped.

    The similarity is rounded to 3 places, as the flags of ``near_duplicates`` are.
    """
    meta = reports.select(F.col("id").cast("long").alias("id"), "component",
                          T.clip(F.col("summary"), summary_chars).alias("summary"))
    return (nn.join(meta, "id", "inner")
            .select("qid", "rank", "id", F.round("sim", 3).alias("sim"),
                    "component", "summary"))


def near_duplicates(nn: DataFrame, min_sim: float = 0.75, limit: int = 5) -> DataFrame:
    """Flag neighbours at or above ``min_sim`` after rounding to 3, first ``limit``.

    Expects ``knn_join`` output (searched with k = limit + 1 in the reference).
    """
    flagged = nn.withColumn("sim3", F.round("sim", 3)).filter(F.col("sim3") >= F.lit(min_sim))
    w = Window.partitionBy("qid").orderBy("rank")
    return (flagged.withColumn("flag_rank", F.row_number().over(w).cast("int"))
            .filter(F.col("flag_rank") <= limit).drop("flag_rank"))


def flag_ids(flags: DataFrame) -> DataFrame:
    """Comma-joined flagged neighbour ids per query in rank order."""
    return (flags.groupBy("qid")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))),
                                          lambda s: s["id"].cast("string")), ",").alias("dup_ids")))


def lookup(ids: DataFrame, reports: DataFrame, id_col: str = "id",
           description_chars: int = T.DESCRIPTION_LOOKUP_CHARS) -> DataFrame:
    """Report lookup by id with clipped description and a found flag."""
    r = reports.select(F.col("id").cast("long").alias("_rid"), "component", "summary",
                       T.clip(F.col("description"), description_chars).alias("description"))
    j = ids.select(F.col(id_col).cast("long").alias("id")).join(r, F.col("id") == F.col("_rid"), "left")
    return j.select("id", F.col("_rid").isNotNull().alias("found"), "component", "summary", "description")


def similar(ids: DataFrame, vectors: DataFrame, reports: DataFrame, k: int = 6, id_col: str = "id") -> DataFrame:
    """Similar reports for many ids at once (F3: the ``search_similar`` tool as a join).

    Ids without a stored vector are skipped; neighbours unknown to ``reports``
    are dropped.
    """
    q = vectors.join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    return enrich_neighbours(knn_join(q, vectors, k), reports)
