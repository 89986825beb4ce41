"""URL filters: longest matching (host, path) prefix rule by a sorted sweep.

A host is keyed by its labels in reverse order, each closed by a separator
(``org . example .``), so a rule's host and all its subdomains are one interval
of the sorted keys and intervals of nested rules nest. Each interval puts two
boundary rows into the sort: its opening carries the stack of rules active
inside it (the rules of its host and of all hosts above it), its closing the
stack outside. Sweeping urls and boundaries in key order, the last boundary
seen holds the active rules of a url; the longest one whose path starts the
url's path wins.

The urls are dealt over sweeps by a hash of the row, so a host with a third of
all pages is spread over all of them; the boundary rows (two per rule host)
go to every sweep. Nothing is broadcast or joined on a host. A sweep therefore
sorts its share of the urls plus the boundary rows, and a stack holds the rules
of one host chain.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and the default verdict; repeated rows are judged each on its own; of
equally long rules the longer host and then the smaller text wins; ports and
user names are part of the host, as the contract cuts it; an empty rules table
gives the default verdict to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, shuffle_width

SEP, SEP_NEXT = "\x01", "\x02"
DEFAULT_VERDICT = "allow"
# The rules of the registered query (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased up to ``/?#``, path up to ``?#``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP))


def _suffixes(host: Column) -> Column:
    """The host and every host above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, kind 0, stack): the active rules from each key on, two rows per rule host."""
    own = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).dropDuplicates(["host", "path"])
           .withColumn("host", lower_ascii(F.col("host"))).groupBy("host")
           .agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own")))
    above = own.select(F.col("host").alias("inner"), F.explode(_suffixes(F.col("host"))).alias("host"))
    hit = above.join(own, "host")
    empty = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    stacks = hit.groupBy("inner").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("host") != F.col("inner"), F.col("own")))).alias("outside"))
    key = host_key(F.col("inner"))
    opened = stacks.select(key.alias("key"), F.col("inside").alias("stack"))
    closed = stacks.select(F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit(SEP_NEXT)).alias("key"),
                           F.coalesce("outside", empty).alias("stack"))
    return opened.unionByName(closed)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT,
                sweeps: int | None = None) -> DataFrame:
    """Rows of (page_id, url) -> page_id, host, path, rule, verdict."""
    sweeps = sweeps or shuffle_width(pages.sparkSession)
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", F.pmod(F.xxhash64("page_id", "url"), F.lit(sweeps)).alias("sweep"),
                        host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"key": host_key(F.col("host")), "kind": F.lit(1)})
    marks = (boundaries(rules).withColumn("kind", F.lit(0))
             .withColumn("sweep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long")))))
    both = urls.unionByName(marks, allowMissingColumns=True)
    order = (Window.partitionBy("sweep").orderBy("key", "kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1")
    fits = swept.select("page_id", "host", "path", F.explode_outer(F.slice(F.sort_array(F.transform(F.filter(
        "active", lambda r: F.col("path").startswith(r["path"])
        & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"])))),
        lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("long"),
                           (-F.length(r["host"])).alias("long_host"), F.concat(r["host"], r["path"]).alias("rule"),
                           r["verdict"].alias("verdict")))), 1, 1)).alias("best"))
    return fits.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
