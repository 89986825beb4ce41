"""Agent-trace analytics over a long trace table, one row per decision.

Input: ``(run_id, step, node, text)`` where ``node`` is the routed decision
(research / extract / critique / FINISH) and ``text`` the reply of that
node. Aggregates over runs (counts, tool use, yields) are partial
aggregates. The per-run ordered outputs (trajectory text and signature) are
by definition as long as the run, which the agent runtime caps at its
decision budget; the route audit and attempts are running windows over one
run (they stream through the sorted run and spill if a run is huge). The
evidence digest only ever collects its last ``n`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import extraction as EX
from tessera.session import keep_last_json_key

# Decision names, their one-letter abbreviations, the budget.
RESEARCH, EXTRACT, CRITIQUE, FINISH = "research", "extract", "critique", "FINISH"
ALLOWED = (RESEARCH, EXTRACT, CRITIQUE, FINISH)
ABBREVIATIONS = {"research": "R", "extract": "E", "critique": "C", "FINISH": "F"}
STEP_BUDGET = 10
ARROW = " → "
SIG_ARROW = "→"


def decisions(trace: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename raw node labels to decision names (identity when no mapping)."""
    if not mapping:
        return trace
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return trace.withColumn("node", F.coalesce(F.try_element_at(m, F.col("node")), F.col("node")))


def _ordered_nodes(trace: DataFrame) -> DataFrame:
    return trace.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda s: s["node"]).alias("nodes"))


def trajectory(trace: DataFrame) -> DataFrame:
    """Per run, decisions in step order joined by `` → ``."""
    return _ordered_nodes(trace).select("run_id", F.array_join("nodes", ARROW).alias("trajectory"))


def signature_of(nodes) -> F.Column:
    """``R→E→C  (3)``: abbreviations, else first letter upper-cased."""
    m = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    abbr = F.transform(nodes, lambda n: F.coalesce(F.try_element_at(m, n), F.upper(F.substring(n, 1, 1))))
    return F.concat(F.array_join(abbr, SIG_ARROW), F.lit("  ("), F.size(nodes).cast("string"), F.lit(")"))


def signatures(trace: DataFrame) -> DataFrame:
    """Per run trajectory signature."""
    return _ordered_nodes(trace).select("run_id", signature_of(F.col("nodes")).alias("signature"))


def trajectory_counts(trace: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent signatures, ties by signature."""
    return (signatures(trace).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("signature").asc()).limit(top))


def trajectory_summary(trace: DataFrame) -> DataFrame:
    """Runs and distinct signatures."""
    return signatures(trace).agg(F.count(F.lit(1)).alias("n_runs"),
                                 F.countDistinct("signature").alias("n_distinct"))


def extract_counts(trace: DataFrame) -> DataFrame:
    """Extractions, steps and research use per run."""
    return trace.groupBy("run_id").agg(
        F.count_if(F.col("node") == EXTRACT).cast("int").alias("n_extract"),
        F.count(F.lit(1)).cast("int").alias("steps"),
        F.max((F.col("node") == RESEARCH)).alias("used_research"))


def tool_usage(trace: DataFrame, tool_col: str = "node", result_col: str = "text") -> DataFrame:
    """Calls, error replies and runs per tool."""
    err = F.coalesce(F.col(result_col).contains('"error"'), F.lit(False))
    return trace.groupBy(F.col(tool_col).alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(err).alias("errors"),
        F.countDistinct("run_id").alias("runs"))


def evidence_digest(trace: DataFrame, n: int = 6, tool_col: str = "node") -> DataFrame:
    """Per run, the last ``n`` evidence items in order.

    ``row_number()`` over the steps in reverse keeps the last ``n`` rows of a
    run (cut per task before the shuffle), so only ``n`` items per run are
    ever collected, however long the run.
    """
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc())
    last = (trace.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .select("run_id", "step", F.coalesce(F.col(tool_col), F.lit("note")).alias("t")))
    return last.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "t"))), lambda x: x["t"]).alias("digest"))


def _with_state(trace: DataFrame) -> DataFrame:
    """Adds, per decision, the state before it: decision index and the current
    extraction (the last extract reply so far; an unreadable one is null)."""
    keep_last_json_key(trace.sparkSession)
    w = Window.partitionBy("run_id").orderBy("step")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parsed = EX.parse_json_lenient(F.col("text"))
    is_ext = F.col("node") == EXTRACT
    t = (trace.withColumn("_idx", (F.row_number().over(w) - 1).cast("int"))
         .withColumn("_ext_json", F.when(is_ext, F.coalesce(F.to_json(parsed), F.lit("null")))))
    # last extraction reply before this decision ('null' marks an unreadable one)
    t = t.withColumn("_cur", F.last("_ext_json", ignorenulls=True).over(before))
    return t.withColumn("has_extraction", F.coalesce(F.col("_cur") != "null", F.lit(False)))


def audit_routes(trace: DataFrame, budget: int = STEP_BUDGET) -> DataFrame:
    """Would each proposed route pass the supervisor's rules?.

    Rules in order: at or over the budget -> FINISH; an unknown route -> extract
    when there is no extraction yet, else critique; critique or FINISH with no
    extraction -> extract. Returns the repaired route and the rule applied.
    """
    t = _with_state(trace)
    node, has = F.col("node"), F.col("has_extraction")
    unknown_fix = F.when(has, F.lit(CRITIQUE)).otherwise(F.lit(EXTRACT))
    step1 = F.when(node.isin(*ALLOWED), node).otherwise(unknown_fix)
    repaired = (F.when(F.col("_idx") >= budget, F.lit(FINISH))
                .when(step1.isin(CRITIQUE, FINISH) & ~has, F.lit(EXTRACT))
                .otherwise(step1))
    reason = (F.when(F.col("_idx") >= budget, F.lit("over budget"))
              .when(~node.isin(*ALLOWED), F.lit("unknown route"))
              .when(node.isin(CRITIQUE, FINISH) & ~has, F.lit("no extraction yet"))
              .otherwise(F.lit("")))
    return t.select("run_id", "step", "node", has.alias("has_extraction"), repaired.alias("repaired"),
                    (node == repaired).alias("legal"), reason.alias("rule"))


def attempts(trace: DataFrame) -> DataFrame:
    """Critic verdicts in order with the attempt they judge.

    Each critique row judges the latest extraction: a schema failure rejects it
    with ``schema error: <reason>``; otherwise the critic reply's ``ok``
    decides by its truth value (null, 0, '' and empty containers reject), a
    missing ``ok`` or an unreadable reply counting as accepted. ``attempt`` is the
    number of extractions so far; ``retry_of_rejection`` marks a verdict that
    follows a rejection.
    """
    t = _with_state(trace)
    w = Window.partitionBy("run_id").orderBy("step")
    n_ext = F.sum((F.col("node") == EXTRACT).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("attempt", n_ext.cast("int"))
    crit = t.filter(F.col("node") == CRITIQUE)
    cur = F.parse_json(F.coalesce(F.col("_cur"), F.lit("null")))
    ok_schema, why = EX.validate_extraction(cur)
    reply = EX.parse_json_strict(F.col("text"))  # critic replies are read as strict JSON
    verdict = EX.truthy(F.try_variant_get(reply, "$.ok", "variant"), missing=True)
    ok = F.when(ok_schema, verdict).otherwise(F.lit(False))
    reason = F.when(~ok_schema, F.concat(F.lit("schema error: "), why)).otherwise(
        F.coalesce(F.try_variant_get(reply, "$.reason", "string"), F.lit("")))
    out = crit.select("run_id", "step", "attempt", ok.alias("ok"), reason.alias("reason"))
    wc = Window.partitionBy("run_id").orderBy("step")
    return out.withColumn("retry_of_rejection",
                          F.coalesce(~F.lag("ok").over(wc), F.lit(False)))


def run_outcomes(trace: DataFrame) -> DataFrame:
    """Per run: steps, extractions, research use, final verdict (Q17).

    ``ok`` is the verdict of the last critique after the last extraction,
    false when there is none.
    """
    att = attempts(trace)
    last_ext = trace.groupBy("run_id").agg(F.max(F.when(F.col("node") == EXTRACT, F.col("step"))).alias("_le"))
    last_crit = (att.join(last_ext, "run_id").filter(F.col("_le").isNull() | (F.col("step") > F.col("_le")))
                 .groupBy("run_id").agg(F.max_by("ok", "step").alias("ok")))
    return (extract_counts(trace).join(last_crit, "run_id", "left")
            .withColumn("ok", F.coalesce(F.col("ok"), F.lit(False))))


def extraction_yield(outcomes: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Final and first-pass yield, gain, mean steps, share without research.

    ``flags`` (``run_id`` per flagged run) adds the flagged-run count. Zero
    runs give nulls rather than an error (Q9).
    """
    o = outcomes
    if flags is not None:
        o = o.join(flags.select("run_id").distinct().withColumn("_flag", F.lit(1)), "run_id", "left")
    aggs = [F.count(F.lit(1)).alias("n_runs"),
            F.avg(F.col("ok").cast("double")).alias("final_yield"),
            F.avg((F.col("ok") & (F.col("n_extract") == 1)).cast("double")).alias("first_pass_yield"),
            F.avg(F.col("steps").cast("double")).alias("mean_steps"),
            F.avg((~F.col("used_research")).cast("double")).alias("no_research_share")]
    if flags is not None:
        aggs.append(F.count("_flag").alias("n_flagged"))
    return o.agg(*aggs).withColumn("gain", F.col("final_yield") - F.col("first_pass_yield"))
