"""Column expressions for model replies: tolerant JSON and schema validation.

Parsing uses Spark's VARIANT type (``try_parse_json``), so replies stay in the
JVM; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws

# Field catalog of an extraction, its allowed levels and kinds.
FIELD_DEFINITIONS = {
    "area": "the affected subsystem/topic (short label)",
    "severity": "impact level, one of the allowed enums",
    "kind": "defect category, one of the allowed enums",
}
SEVERITIES = ("low", "med", "high")
KINDS = ("crash", "ui", "performance", "security", "data", "other")
FIELD_ENUMS = {"severity": list(SEVERITIES), "kind": list(KINDS)}
# Rejection reasons, in the order they are checked.
REASON_NOT_OBJECT = "not a JSON object"
REASON_MISSING_AREA = "missing 'area'"
REASON_BAD_SEVERITY = "bad 'severity'"
REASON_BAD_KIND = "bad 'kind'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_json_strict(col) -> Column:
    """The whole string as one JSON value, else null. Returns VARIANT.

    The JVM parser reads one value and ignores what follows it, so the text is
    parsed once, as the first of two elements of an array whose second is a hash
    of the text: the hash is read at that place only if the text is one value
    and nothing else. A key that an object repeats keeps its last value where
    the session allows that (``keep_last_json_key``).
    """
    c = _c(col)
    seal = F.concat(F.lit("="), F.hex(F.xxhash64(c)), F.hex(F.hash(c)))
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), seal, F.lit('"]')))
    whole = F.transform(F.array(listed), lambda v: F.when(
        F.try_variant_get(v, "$[1]", "string") == seal, F.try_variant_get(v, "$[0]", "variant")))
    # only what begins like a JSON value is worth a parse
    return F.when(c.rlike(r'^\s*[\[{"\-0-9tfn]'), F.get(whole, F.lit(0)))


def parse_json_lenient(col) -> Column:
    """Whole string as JSON, else the span from the first ``{`` to the last ``}``
    (across lines), else null (P12). Returns VARIANT; each of the two is parsed once at most."""
    c = _c(col)
    return F.coalesce(parse_json_strict(c), parse_json_strict(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def truthy(v: Column, missing: bool) -> Column:
    """Truth of a JSON value: null, false, 0, "", [] and {} are false; a missing value is ``missing``."""
    text = F.to_json(v)
    empty = text.isin("null", "false", '""', "[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.coalesce(~empty, F.lit(missing))


FIELDS_TYPE = "struct<area: variant, severity: variant, kind: variant>"


def extraction_fields(v: Column) -> Column:
    """The three extraction fields of a reply as a struct of VARIANTs.

    One lookup for all fields; null when the reply is not a JSON object (the
    cast to a struct only succeeds for objects).
    """
    return F.try_variant_get(v, "$", FIELDS_TYPE)


def variant_string(x: Column) -> Column:
    """The value as string when the VARIANT holds a JSON string, else null."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _field_strings(f: Column) -> Column:
    """The three fields as strings, with whether there was an object at all."""
    return F.struct(f.isNotNull().alias("object"), *[variant_string(f[n]).alias(n) for n in FIELD_DEFINITIONS])


def _reason(s: Column, severities: Sequence[str], kinds: Sequence[str]) -> Column:
    """The first check that the fields (``_field_strings``) fail, '' for none."""
    return (F.when(~s["object"], F.lit(REASON_NOT_OBJECT))
            .when(s["area"].isNull() | (strip_ws(s["area"]) == ""), F.lit(REASON_MISSING_AREA))
            .when(s["severity"].isNull() | ~s["severity"].isin(*severities), F.lit(REASON_BAD_SEVERITY))
            .when(s["kind"].isNull() | ~s["kind"].isin(*kinds), F.lit(REASON_BAD_KIND))
            .otherwise(F.lit("")))


def field_checks(v: Column, severities: Sequence[str] = SEVERITIES, kinds: Sequence[str] = KINDS) -> Column:
    """Array of one struct (parsed, area, severity, kind, ok, reason) for a parsed reply (VARIANT; P11).

    Every step is a lambda over the one before, so the reply, each of its fields
    and the reason are computed once per row wherever the struct is used.
    """
    read = F.transform(F.array(v), lambda x: F.struct(x.isNotNull().alias("parsed"), extraction_fields(x).alias("f")))
    text = F.transform(read, lambda x: F.struct(x["parsed"].alias("parsed"), _field_strings(x["f"]).alias("s")))
    judged = F.transform(text, lambda x: F.struct(
        x["parsed"].alias("parsed"), x["s"].alias("s"), _reason(x["s"], severities, kinds).alias("reason")))
    return F.transform(judged, lambda x: F.struct(
        x["parsed"].alias("parsed"), *[x["s"][n].alias(n) for n in FIELD_DEFINITIONS],
        (x["reason"] == "").alias("ok"), x["reason"].alias("reason")))


def validate_fields(f: Column, severities: Sequence[str] = SEVERITIES,
                    kinds: Sequence[str] = KINDS) -> tuple[Column, Column]:
    """(ok, reason) from ``extraction_fields``; the first failing check wins.

    not an object -> missing or blank area -> severity not allowed -> kind not allowed.
    """
    reason = F.get(F.transform(F.transform(F.array(f), _field_strings), lambda s: _reason(s, severities, kinds)),
                   F.lit(0))
    return reason == "", reason


def validate_extraction(v: Column, severities: Sequence[str] = SEVERITIES,
                        kinds: Sequence[str] = KINDS) -> tuple[Column, Column]:
    """(ok, reason) for a parsed reply (VARIANT); see ``validate_fields``."""
    return validate_fields(extraction_fields(v), severities, kinds)


def judge_score(reply) -> Column:
    """Integer ``score`` of a judge reply (strict JSON), null when unreadable."""
    return F.try_variant_get(parse_json_strict(_c(reply)), "$.score", "int")
