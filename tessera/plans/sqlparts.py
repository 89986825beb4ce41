"""SQL fragments shared by the oracle queries (DuckDB twins of the column functions)."""

from __future__ import annotations

from tessera.functions import text as T
from tessera.functions.extraction import KINDS as EX_KINDS, SEVERITIES as EX_SEVERITIES
from tessera.operators import stats as ST
from tessera.plans import testdata as td
from tessera.plans.oracle_views import _DEPENDS, VIEWS

WORD = T.WORD_PATTERN


WS_SQL = " || ".join(f"chr({c})" for c in T.WS_CODEPOINTS)


def s_strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def s_words(e: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({e}, ''), '{WORD}')) AS INTEGER)"


def s_compose(comp: str, summ: str, desc: str) -> str:
    c, s, d = (s_strip(f"coalesce({x}, '')") for x in (comp, summ, desc))
    head = f"(CASE WHEN {c} <> '' THEN '[' || {c} || '] ' || {s} ELSE {s} END)"
    return (f"(CASE WHEN {d} <> '' THEN {s_strip(head + ' || chr(10) || ' + d)} "
            f"ELSE {head} END)")


def s_severity(e: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k.strip().lower()}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE lower({s_strip(e)}) {whens} END)"


def s_wilson(c: str, n: str, z: float = ST.Z_95) -> tuple[str, str]:
    p = f"({c}::DOUBLE / {n})"
    den = f"(1 + {z}*{z} / {n})"
    centre = f"(({p} + {z}*{z} / (2.0 * {n})) / {den})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z}*{z} / (4.0 * {n} * {n})) / {den})"
    return f"{centre} - {half}", f"{centre} + {half}"

def s_clean_label(reply: str, cluster: str) -> str:
    first = (f"split_part(regexp_replace(nullif({s_strip(reply)}, ''), '{T.LINE_BREAK_PATTERN}', chr(10), 'g'), "
             "chr(10), 1)")
    return f"coalesce(left(trim(trim({s_strip(first)}, '\"'), '.'), 40), 'cluster ' || {cluster})"


VIEWS_RTEXT = f"SELECT id, {s_compose('component', 'summary', 'description')} AS text FROM reports"

def s_lenient(t: str) -> str:
    span = f"regexp_extract({t}, '(?s)\\{{.*\\}}')"
    return f"(CASE WHEN json_valid({t}) THEN {t} WHEN json_valid({span}) THEN {span} END)"


def s_field(p: str, name: str) -> str:
    return f"(CASE WHEN json_type({p}, '$.{name}') = 'VARCHAR' THEN json_extract_string({p}, '$.{name}') END)"


def s_reason(p: str) -> str:
    area, sev, kind = s_field(p, "area"), s_field(p, "severity"), s_field(p, "kind")
    sevs = ", ".join(f"'{x}'" for x in EX_SEVERITIES)
    kinds = ", ".join(f"'{x}'" for x in EX_KINDS)
    return (f"(CASE WHEN {p} IS NULL OR json_type({p}) <> 'OBJECT' THEN 'not a JSON object' "
            f"WHEN {area} IS NULL OR {s_strip(area)} = '' THEN 'missing ''area''' "
            f"WHEN {sev} IS NULL OR {sev} NOT IN ({sevs}) THEN 'bad ''severity''' "
            f"WHEN {kind} IS NULL OR {kind} NOT IN ({kinds}) THEN 'bad ''kind''' ELSE '' END)")


# Model-style replies derived from every order row (twin of testdata.extraction_replies),
# with the leniently parsed JSON next to them.
VIEWS["replies"] = f"""
        SELECT id, component, summary, reply, {s_lenient('reply')} AS p FROM (
          SELECT id, component, summary,
                 CASE WHEN severity = '5-LOW' THEN 'Here is the JSON:' || chr(10) || body || chr(10) || 'Done.'
                      WHEN severity = '4-NOT SPECIFIED' THEN 'I could not decide.'
                      WHEN severity = '3-MEDIUM' AND id % 3 = 0 THEN '12 reports seen: ' || body
                      WHEN severity = '3-MEDIUM' AND id % 3 = 1 THEN '"sure" ' || body || ' true'
                      ELSE body END AS reply
          FROM (SELECT id, component, summary, severity,
                       json_object('area', component, 'severity', {s_severity('severity', td.ORDER_PRIORITY_SEVERITY)},
                                   'kind', CASE status WHEN 'F' THEN 'data' WHEN 'O' THEN 'other'
                                           ELSE 'pending' END)::VARCHAR AS body
                FROM severity_reports))"""
_DEPENDS["replies"] = ["severity_reports"]


def _sql_pick(n: str, values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({n} % {len(values)} + 1 AS INTEGER))"


# Twin of testdata.agent_trace.
VIEWS["agent_trace"] = f"""
        SELECT run_id, step, node, flagged,
               CASE node WHEN 'extract' THEN {_sql_pick('step // 7', td.EXTRACT_REPLIES)}
                         WHEN 'critique' THEN {_sql_pick('step // 7', td.CRITIC_REPLIES)}
                         ELSE {_sql_pick('step // 7', td.TOOL_REPLIES)} END AS text
        FROM (SELECT o_custkey AS run_id, o_orderkey AS step, o_orderpriority = '1-URGENT' AS flagged,
                     CASE o_orderkey % 13 % 7 WHEN 0 THEN 'research' WHEN 1 THEN 'extract' WHEN 2 THEN 'critique'
                          WHEN 3 THEN 'extract' WHEN 4 THEN 'critique' WHEN 5 THEN 'FINISH' ELSE 'summarise' END AS node
              FROM orders)"""
