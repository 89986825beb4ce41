"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) take the weights in turn and
share ``share`` times all words; a target stops at ``max_repeat`` times its
source and the excess goes to the others by weight. The water level has a
closed form over the sources ordered by cap per weight, so no iteration.

Apportionment: the mix is cut into blocks of ``block_tokens`` words. Blocks go
to the sources, then inside each source to its shards, by the highest
quotients ``votes / (2 k + 1)``. Only the seats near the border are listed as
rows (at most two per candidate and group), the sure ones are counted.

Selection: inside a shard the documents stand end to end in a seeded hash
order, a word line cut into blocks. The shard's quota takes that line whole as
often as it fits and then a run of blocks from a seeded start, so a document's
``taken`` is arithmetic on its place in the line. Shards hold about
``shard_tokens`` words of one source, so a hot source is many small windows.

Defined results: null text has size 0 and takes 0; a null source is a source;
a source without words has target 0; repeated rows are separate rows; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_TOKENS = 16
SHARD_TOKENS = 1 << 18
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> plus rank, target. One row per source throughout."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked.withColumns({"w": w, "cap": F.lit(float(max_repeat)) * F.col("source_size")})
    s = s.withColumn("fill", F.col("cap") / F.col("w"))
    before = (Window.partitionBy(F.lit(0)).orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumns({"total": F.lit(share) * F.sum("source_size").over(everything),
                       "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                       "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    # the water level is that of the first source it does not drown
    s = s.withColumn("level", F.min_by(F.when(F.col("fill") > level, level),
                                       F.when(F.col("fill") > level, F.col("fill"))).over(everything))
    return s.select("source", "source_size", "rank",
                    F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str],
              out: str) -> DataFrame:
    """Adds ``out``, the Sainte-Lague seats of each row within its ``group``.

    With fair shares f and S parties the divisor rule gives a party at least
    ``floor(f (N - S/2)/N + 1/2)`` and at most ``floor(f (N + S/2)/N + 1/2)``
    of N seats; the seats between are ranked by quotient.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumns({"_T": F.sum(votes).over(g), "_S": F.count(F.lit(1)).over(g) / 2})
    part = lambda n: F.when(F.col("_T") > 0, F.floor(F.col(votes) / F.col("_T") * n + 0.5)).otherwise(
        F.lit(0)).cast("long")
    n = F.col(seats)
    p = p.withColumns({"_low": part(F.greatest(n - F.col("_S"), F.lit(0.0))),
                       "_high": part(n + F.col("_S")) + 1})
    p = p.withColumn("_left", n - F.sum("_low").over(g))
    border = (p.filter((F.col("_left") > 0) & (F.col(votes) > 0))
              .withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
              .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1)))
    won = (border.withColumn("_r", F.row_number().over(
        (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
            F.col("_q").desc(), *[F.col(c).asc_nulls_last() for c in order])))
        .filter(F.col("_r") <= F.col("_left")).groupBy(*order).agg(F.count("*").alias("_more")))
    won = won.select(*[F.col(c).alias(f"_o_{c}") for c in order], "_more")
    cond = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in order]
    joined = p.join(won, cond[0] if len(cond) == 1 else cond[0] & cond[1], "left")
    return (joined.withColumn(out, F.col("_low") + F.coalesce(F.col("_more"), F.lit(0)))
            .drop("_T", "_S", "_low", "_high", "_left", "_more", *[f"_o_{c}" for c in order]))


def _hash_mod(key, n):
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
                block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED) -> DataFrame:
    """Rows of (doc_id, source, text) -> doc_id, source, size, source_size, target, taken."""
    b = F.lit(block_tokens)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                       F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                             ).alias("key"))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, share, max_repeat)
    sources = sources.withColumn("n", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / b).cast("long"))
    sources = apportion(sources, [], "target", "n", ["rank"], "quota").withColumnRenamed("source", "s_source")
    cut = rows.join(sources, rows["source"].eqNullSafe(F.col("s_source"))).withColumn(
        "shard", _hash_mod(F.col("key"), F.ceil(F.greatest("source_size", F.lit(1)) / shard_tokens)))
    shards = (cut.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota")))
    shards = apportion(shards, ["rank"], "shard_size", "quota", ["rank", "shard"], "blocks").select(
        F.col("rank").alias("s_rank"), F.col("shard").alias("s_shard"), "shard_size",
        F.least(F.col("blocks") * b, max_repeat * F.col("shard_size")).alias("tokens"),
        (_hash_mod(F.md5(F.concat_ws("|", F.lit(seed), "rank", "shard")),
                   F.ceil(F.greatest("shard_size", F.lit(1)) / b)) * b).alias("start"))
    line = Window.partitionBy("rank", "shard").orderBy("key", "size")
    placed = cut.withColumn("hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    x = placed.join(shards, (F.col("rank") == F.col("s_rank")) & (F.col("shard") == F.col("s_shard")))
    x = x.withColumns({
        "lo": F.col("hi") - F.col("size"),
        "epochs": F.when(F.col("shard_size") > 0, F.expr("tokens div shard_size")).otherwise(F.lit(0)),
    }).withColumn("rest", F.col("tokens") - F.col("epochs") * F.col("shard_size"))
    end = F.col("start") + F.col("rest")
    overlap = lambda a, z: F.greatest(F.lit(0), F.least("hi", z) - F.greatest("lo", a))
    run = overlap(F.col("start"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0), end - F.col("shard_size"))
    return x.select("doc_id", "source", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + run).cast("long").alias("taken"))
