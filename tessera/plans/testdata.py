"""Adapters from the driver's test tables to the report data model.

The mapping follows FIXTURES.md §2; every adapter is a lazy DataFrame job over
whole tables, and each has a SQL twin in ``plans.oracle`` for the DuckDB check.

* reports  <- documents: id = doc_id, component = source, summary = first
  line, description = the rest; role from exact text copies.
* text pairs <- later copies of one text paired with its lowest doc_id.
* vectors <- embeddings (vec_id, embedding, label).
* vector pairs <- each vec_id paired with the lowest vec_id of its label.
* severity reports <- orders joined to customer.
* trace <- conversations (one conversation = one run, role = decision).
* ratings <- labels (quality and toxic as two raters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

# Order priorities as severity levels for the test tables.
ORDER_PRIORITY_SEVERITY = {
    "1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "med", "5-LOW": "low",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, master_id, copies) keyed by a SHA-256 of the text.

    Grouping on the 32-byte binary digest instead of the text keeps whole
    texts out of the shuffle; the aggregate is partial (map-side) so a text
    copied a million times still costs one row per task before the exchange.
    """
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("_h"))
    groups = keyed.groupBy("_h").agg(F.min("doc_id").alias("master_id"), F.count("*").alias("copies"))
    return keyed.join(groups, "_h").drop("_h")


def reports(spark: SparkSession, sf_dir: str, with_role: bool = False) -> DataFrame:
    """Report table from ``documents``; ``role`` (from exact copies) on request.

    The role needs a digest of every text, so it is only computed for the
    queries that read it.
    """
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id"), F.col("source").alias("component"),
                       T.first_line(F.col("text")).alias("summary"),
                       T.after_first_line(F.col("text")).alias("description"),
                       F.col("lang"))
    if with_role:
        g = _text_groups(docs)
        role = (F.when(F.col("copies") == 1, F.lit("corpus"))
                .when(F.col("doc_id") == F.col("master_id"), F.lit("master"))
                .otherwise(F.lit("dup")))
        base = base.join(g.select("doc_id", role.alias("role")), "doc_id")
    return base.withColumnRenamed("doc_id", "id")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    g = _text_groups(docs)
    return g.filter(F.col("doc_id") != F.col("master_id")).select(
        F.col("doc_id").alias("dup_id"), "master_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector paired with the lowest id of its label (itself excluded).

    The label minimum is a partial aggregate joined back, so a label holding a
    third of all rows is still split across tasks.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    m = v.groupBy("label").agg(F.min("vec_id").alias("master_id"))
    return (v.join(m, "label").filter(F.col("vec_id") != F.col("master_id"))
            .select(F.col("vec_id").alias("dup_id"), "master_id"))


def severity_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                              "o_orderdate", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("component"),
        F.col("o_orderpriority").alias("severity"), F.col("c_name").alias("summary"),
        F.col("o_orderdate").alias("creation_time"), F.col("o_orderstatus").alias("status"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("step"),
        F.col("role").alias("node"), "text")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("rater_a"), F.col("toxic").alias("rater_b"))


def agent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision trace over whole ``orders``: a customer is a run, its orders by key the steps.

    The key picks the route (one of seven is unknown) and the reply: readable,
    wrapped, unreadable and invalid extractions; accepting, rejecting, falsy
    and unreadable critic replies; tool errors. ``flagged`` marks urgent orders.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    pick = lambda n, *values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    route = F.col("o_orderkey") % 13 % 7
    node = pick(route, "research", "extract", "critique", "extract", "critique", "FINISH", "summarise")
    which = F.floor(F.col("o_orderkey") / 7)
    text = (F.when(node == "extract", pick(which, *EXTRACT_REPLIES))
            .when(node == "critique", pick(which, *CRITIC_REPLIES))
            .otherwise(pick(which, *TOOL_REPLIES)))
    return o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"), node.alias("node"),
                    text.alias("text"), (F.col("o_orderpriority") == "1-URGENT").alias("flagged"))


# Replies of the agent trace.
EXTRACT_REPLIES = [
    '{"area": "net", "severity": "low", "kind": "ui"}', 'Sure:\n{"area": "net", "severity": "high", "kind": "crash"}.',
    'I could not decide.', '{"area": " ", "severity": "low", "kind": "ui"}',
    '{"area": "net", "severity": "urgent", "kind": "ui"}', '{"area": "net", "severity": "med", "kind": "bug"}',
    '[1, 2]', '12 reports seen: {"area": "dom", "severity": "med", "kind": "data"}',
    '{"area": "a", "severity": "low", "kind": "ui"} or {"area": "b", "severity": "low", "kind": "ui"}',
]
CRITIC_REPLIES = [
    '{"ok": true}', '{"ok": false, "reason": "wrong area"}', '{"reason": "no verdict"}', 'unreadable',
    '{"ok": null, "reason": "null"}', '{"ok": "no"}', '{"ok": ""}', '{"ok": []}', '{"ok": 0}', '{"ok": [0]}',
    '{"ok": true} trailing',
]
TOOL_REPLIES = ['{"error": "timeout"}', '{"results": 3}', 'note']


# The test tables' conversation roles read as routing decisions.
ROLE_AS_DECISION = {"user": "research", "assistant": "extract", "system": "critique"}


def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.trace import decisions
    return decisions(trace(spark, sf_dir), ROLE_AS_DECISION)


def extraction_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-style replies derived from each order row (whole table).

    The body is a JSON object built from the row: area = market segment,
    severity = mapped priority, kind from the order status. Low-priority rows
    wrap it in prose, medium-priority ones put a number or a quoted word before
    it, unspecified-priority rows give no JSON at all.
    """
    r = severity_reports(spark, sf_dir)
    level = T.map_severity(F.col("severity"), ORDER_PRIORITY_SEVERITY)
    kind = (F.when(F.col("status") == "F", F.lit("data")).when(F.col("status") == "O", F.lit("other"))
            .otherwise(F.lit("pending")))
    body = F.to_json(F.struct(F.col("component").alias("area"), level.alias("severity"), kind.alias("kind")))
    reply = (F.when(F.col("severity") == "5-LOW", F.concat(F.lit("Here is the JSON:\n"), body, F.lit("\nDone.")))
             .when(F.col("severity") == "4-NOT SPECIFIED", F.lit("I could not decide."))
             .when((F.col("severity") == "3-MEDIUM") & (F.col("id") % 3 == 0),
                   F.concat(F.lit("12 reports seen: "), body))
             .when((F.col("severity") == "3-MEDIUM") & (F.col("id") % 3 == 1),
                   F.concat(F.lit('"sure" '), body, F.lit(" true")))
             .otherwise(body))
    return r.select("id", "component", "summary", reply.alias("reply"))
