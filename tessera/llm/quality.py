"""Quality rules: fixed text statistics plus a hashed n-gram likelihood ratio.

Words and adjacent word pairs are hashed into ``n_buckets`` counters, once over
the whole raw corpus and once over the distinct texts of the trusted documents.
A document's score is the mean over its n-grams of the log ratio of the trusted
count of the bucket to the count that the raw share of the bucket gives among as
many trusted n-grams, both raised by ``PRIOR`` n-grams, so that n-grams that the
trusted texts have seldom say little. The raw corpus enters by its shares only,
so its size alone changes no verdict, nor do further copies of all its rows; a
trusted document is scored without its own text. Documents under a fixed
threshold are rejected. Everything is DataFrame expressions: the counters are
partial aggregates over exploded buckets (at most ``n_buckets`` rows leave a
task), and their tables come back as a one-row scalar subquery; of the texts
only those of at most ``max_trusted`` ids are shuffled, to find the distinct.

Defined results: a null text has no words and fails the base rule; without any
trusted word the model abstains and the base rule decides alone; repeated rows
are judged each on its own; ties at the threshold are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, words

# The symbols counted by the base statistics.
SYMBOL_RE = r"[#*$%&|<>]"
N_BUCKETS = 1 << 16
#: Bound of the labelled rows that the trusted model is fitted on.
MAX_TRUSTED = 20_000
#: Trusted n-grams per bucket at which the seen and the expected count start alike.
PRIOR = 10
THRESHOLD = -0.13
MIN_WORDS = 50


def _with_grams(docs: DataFrame) -> DataFrame:
    """Adds the words, their hashes and the hashes of adjacent pairs.

    Each array is its own column and every lambda below reads only its own
    variables, so nothing is evaluated again per element.
    """
    n = F.size("_h")
    return (docs.withColumn("_w", words(F.col("text")))
            .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
            .withColumn("_p", F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
                F.zip_with(F.slice("_h", F.lit(1), n - 1), F.slice("_h", F.lit(2), n - 1),
                           lambda a, b: F.xxhash64(a, b)))))


def _covered(grams: Column) -> Column:
    """Positions covered by 3-word windows whose hash occurs twice or more in ``grams``."""
    ranked = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def dup_positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])
    hit = F.flatten(F.transform(let(ranked, dup_positions), lambda p: F.array(p, p + 1, p + 2)))
    return F.size(F.array_distinct(hit))


def _statistics(grams: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    triples = F.when(F.size("_h") < 3, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice("_p", F.lit(1), F.size("_h") - 2), F.slice("_h", F.lit(3), F.size("_h") - 2),
                   lambda a, b: F.xxhash64(a, b)))
    out = grams.withColumns({"_t": triples, "_l": lines}).withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL_RE)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_t")) == F.size("_t"), F.lit(0))
        .otherwise(_covered(F.col("_t"))).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids labelled good (every label row of the id has quality 1), at most ``max_trusted``.

    Past the bound the ids with the smallest hash are taken, a reproducible
    sample that does not depend on row order.
    """
    good = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1"))
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def _bucket_counts(docs: DataFrame, n_buckets: int, name: str) -> DataFrame:
    return (_with_grams(docs.select("text")).select(F.explode(F.concat("_h", "_p")).alias("g"))
            .groupBy(F.pmod("g", F.lit(n_buckets)).cast("int").alias("b")).agg(F.count("*").alias(name)))


def log_ratios(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row, a struct of arrays by bucket: log ratios ``m`` (null without a trusted n-gram), trusted
    counts ``t`` and raw shares ``p``, and the number ``nt`` of trusted n-grams."""
    texts = docs.join(F.broadcast(trusted), "doc_id", "left_semi").select("text").distinct()
    dense = (docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("b"))
             .join(_bucket_counts(docs, n_buckets, "r"), "b", "left")
             .join(_bucket_counts(texts, n_buckets, "t"), "b", "left"))
    table = dense.agg(F.sort_array(F.collect_list(F.struct(
        "b", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")))).alias("x"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("nt"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr"))
    counted = table.select("nt", F.transform("x", lambda x: x["t"]).alias("t"),
                           F.transform("x", lambda x: F.try_divide(x["r"], F.col("nr"))).alias("p"))
    return counted.select(F.struct(
        F.when(F.col("nt") > 0, F.zip_with("t", "p", lambda t, p: F.log(
            (t + PRIOR) / (p * F.col("nt") + PRIOR)))).alias("m"), "t", "p", "nt").alias("model"))


def _without_own(buckets: Column, model: Column) -> Column:
    """Sum of the log ratios of a trusted text's buckets, its own counts left out."""
    # the state carries the trusted n-grams left, so that no element works them out again
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"),
                     (model["nt"] - F.size(buckets)).alias("left"))

    def ratio(b: Column, n: Column, left: Column) -> Column:
        seen, expected = F.get(model["t"], b) - n, F.get(model["p"], b) * left
        return F.when(n > 0, n * F.log((seen + PRIOR) / (expected + PRIOR))).otherwise(F.lit(0.0))
    # runs of equal buckets; the end mark closes the last one
    runs = F.aggregate(
        F.concat(F.array_sort(buckets), F.array(F.lit(-1))), start,
        lambda a, b: F.when(a["b"] == b, F.struct(b.alias("b"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"),
                                               a["left"].alias("left")))
        .otherwise(F.struct(b.alias("b"), F.lit(1).cast("long").alias("n"),
                            (a["sum"] + ratio(a["b"], a["n"], a["left"])).alias("sum"), a["left"].alias("left"))))
    return runs["sum"]


def judge_quality(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS,
                  max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and any others, kept as struct ``row``): its
    statistics, ``llr`` score and the verdict ``kept``."""
    trusted = trusted_ids(labels, max_trusted)
    model = log_ratios(docs, trusted, n_buckets).scalar()
    own = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_own")))
    rows = docs.select(F.struct("*").alias("row"), "text")
    rows = rows.join(own, F.col("row.doc_id") == F.col("_id"), "left")
    scored = _statistics(_with_grams(rows)).withColumn(
        "_g", F.transform(F.concat("_h", "_p"), lambda g: F.pmod(g, F.lit(n_buckets)).cast("int")))

    def score(m: Column) -> Column:
        total = F.when(F.col("_own"), _without_own(F.col("_g"), m)).otherwise(
            F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.get(m["m"], b)))
        return F.when((F.size("_g") > 0) & (m["nt"] > 0), total / F.size("_g"))
    # the model is a column of its own that is read once, so its arrays are never copied into the rows
    llr = let(F.col("_m"), score)
    scored = scored.withColumn("_m", model)
    judged = scored.withColumn("llr", llr).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True)))
    # a filter on what a generator gives stays above it, so it does not carry the work below along
    return judged.select("row", F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"))))
