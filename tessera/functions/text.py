"""Column expressions over report text (JVM-side, codegen-friendly).

All functions take and return ``Column`` objects so they stay inside
whole-stage codegen; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.split()`` / ``str.strip()``
# treat as whitespace, written once as a Java/RE2-compatible class so Spark and
# the SQL oracle split and trim text the same way.
WS_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD_PATTERN = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]+"
EDGE_WS_PATTERN = WS_CLASS + "+$|^" + WS_CLASS + "+"
# The same characters as a plain set, for trimming the ends without a regex.
WS_CODEPOINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                 *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)
# Line breaks recognised by Python's ``str.splitlines()``.
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Severity vocabulary of the reports (raw label -> level).
DEFAULT_SEVERITY_MAP = {
    "s1": "high", "s2": "high", "critical": "high", "blocker": "high", "major": "high",
    "s3": "med", "normal": "med",
    "s4": "low", "minor": "low", "trivial": "low",
}

# Character budgets used by the evaluation (fixed values).
SUMMARY_META_CHARS = 200
SUMMARY_NEIGHBOUR_CHARS = 120
DESCRIPTION_LOOKUP_CHARS = 1200
REPRESENTATIVE_CHARS = 200
LABEL_CHARS = 40


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    """Trim Unicode whitespace at both ends (Python ``str.strip()``)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def blank_to_empty(col) -> Column:
    """Null -> '' then trimmed."""
    return strip_ws(F.coalesce(_c(col), F.lit("")))


def compose_text(component, summary, description) -> Column:
    """``[component] summary`` + newline + description, empty parts skipped.

    The head is not re-trimmed when the description is empty, matching the
    report builder: a component without summary keeps its trailing blank.
    """
    comp = blank_to_empty(component)
    summ = blank_to_empty(summary)
    desc = blank_to_empty(description)
    head = F.when(comp != "", F.concat(F.lit("["), comp, F.lit("] "), summ)).otherwise(summ)
    return F.when(desc != "", strip_ws(F.concat(head, F.lit("\n"), desc))).otherwise(head)


def word_count(col) -> Column:
    """Whitespace-separated word count, null -> 0."""
    return F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(WORD_PATTERN)).cast("int")


def clip(col, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(col), 1, n)


def as_id(col) -> Column:
    """Null-safe id cast; unreadable ids become null."""
    return _c(col).try_cast("long")


def first_line(col) -> Column:
    """Text before the first newline (the whole text when there is none)."""
    return F.substring_index(_c(col), "\n", 1)


def after_first_line(col) -> Column:
    """Text after the first newline, '' when there is none."""
    c = _c(col)
    pos = F.instr(c, "\n")
    return F.when(pos > 0, c.substr(pos + 1, F.length(c))).otherwise(F.lit(""))


def map_severity(col, mapping: dict[str, str] | None = None) -> Column:
    """Raw severity -> level via a literal map; unknown -> null."""
    mapping = DEFAULT_SEVERITY_MAP if mapping is None else mapping
    m = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.strip().lower(), v)])
    key = F.lower(strip_ws(_c(col).cast("string")))
    return F.try_element_at(m, key)


def similarity(dist) -> Column:
    """Similarity from cosine distance, rounded to 3."""
    return F.round(F.lit(1.0) - _c(dist), 3)


def clean_label(reply, cluster, chars: int = LABEL_CHARS) -> Column:
    """Cluster name from a free-text reply.

    First line of the stripped reply, stripped again, then ``"`` and ``.``
    stripped from both ends, cut at ``chars`` characters. A null or blank reply
    falls back to ``cluster <id>``.
    """
    body = F.nullif(strip_ws(_c(reply)), F.lit(""))
    line = F.element_at(F.split(body, LINE_BREAK_PATTERN, 2), 1)
    name = F.substring(F.btrim(F.btrim(strip_ws(line), F.lit('"')), F.lit(".")), 1, chars)
    return F.coalesce(name, F.concat(F.lit("cluster "), _c(cluster).cast("string")))


def extraction_json(area, severity, kind) -> Column:
    """Extracted fields serialised as one JSON object."""
    return F.to_json(F.struct(_c(area).alias("area"), _c(severity).alias("severity"),
                              _c(kind).alias("kind")), {"ignoreNullFields": "false"})


def judge_text(component, summary, description) -> Column:
    """``[component] summary`` newline description, nulls as '' (P10)."""
    return F.concat(F.lit("["), F.coalesce(_c(component), F.lit("")), F.lit("] "),
                    F.coalesce(_c(summary), F.lit("")), F.lit("\n"),
                    F.coalesce(_c(description), F.lit("")))


def binarise_score(score, threshold: float = 5) -> Column:
    """Judge score -> 1 when >= threshold, unreadable -> 0."""
    return F.coalesce((_c(score) >= F.lit(threshold)).cast("int"), F.lit(0))


def year_of(col) -> Column:
    """Year of an ISO-8601 text (its first four characters) or of a timestamp (P20).

    A text is never read through the session's time zone. A timestamp column
    has no text of its own, so its year is that of the session zone, as its
    text form would be.
    """
    return F.substring(_c(col).cast("string"), 1, 4).try_cast("int")
