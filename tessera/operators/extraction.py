"""Extraction checks: best-match of free-text areas to the taxonomy, scored
replies, judge hook.

``nearest_name`` finds the taxonomy entry most similar to every distinct value
(no cutoff: each value always gets an answer). The names lie in blocks by their
length. A value first meets the block of its own length, which gives it a score
to beat, and then only the blocks whose lengths can still reach that score. In
a block two bounds rule names out: the shared characters with their counts, one
matrix product for all names, and the longest common subsequence, bit-parallel
over the names that are left. ``difflib`` runs for what survives. The edit
distance is Spark's own ``levenshtein``.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import extraction as EX
from tessera.functions import text as T
from tessera.session import keep_last_json_key

_MATCH = pa.schema([("value", pa.string()), ("name", pa.string()), ("score", pa.float64())])
_MATCH_DDL = "value string, name string, score double"
# Names of a block, and values that meet one in a task.
NAME_ROWS, VALUE_ROWS = 4096, 1 << 16


class NameBlock:
    """Names with an index of their characters: the n-th occurrence of a character is a feature."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.size = np.array([len(n) for n in self.names])
        self.code = np.zeros((len(names), int(self.size.max(initial=0))), np.int64)
        for i, n in enumerate(self.names):
            self.code[i, :len(n)] = [ord(c) + 1 for c in n]  # 0 is past the end
        self.feature: dict[tuple[str, int], int] = {}
        rows, cols = [], []
        for i, n in enumerate(self.names):
            for f in self._features(n):
                rows.append(i)
                cols.append(self.feature.setdefault(f, len(self.feature)))
        self.has = np.zeros((len(names), max(1, len(self.feature))), np.float32)
        self.has[rows, cols] = 1

    @staticmethod
    def _features(text: str) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for c in text:
            seen[c] = seen.get(c, 0) + 1
            out.append((c, seen[c]))
        return out

    def shared(self, value: str) -> np.ndarray:
        """Characters that each name shares with the value, with their counts."""
        own = np.zeros(self.has.shape[1], np.float32)
        own[[self.feature[f] for f in self._features(value) if f in self.feature]] = 1
        return self.has @ own

    def subsequence(self, value: str, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with each of some names (a value of 63 characters at most)."""
        places = {}
        for i, c in enumerate(value):
            places[ord(c) + 1] = places.get(ord(c) + 1, 0) | 1 << i
        keys = np.array(sorted(places), np.int64)
        bits = np.array([places[k] for k in keys.tolist()], np.uint64)
        open_ = np.full(len(rows), np.uint64((1 << 63) - 1))
        for column in self.code[rows, :int(self.size[rows].max(initial=0))].T:
            at = np.minimum(np.searchsorted(keys, column), len(keys) - 1)
            met = open_ & np.where(keys[at] == column, bits[at], np.uint64(0))
            open_ = ((open_ + met) | (open_ - met)) & np.uint64((1 << 63) - 1)
        closed = ~open_ & np.uint64((1 << len(value)) - 1)
        return np.bitwise_count(closed).astype(np.int64)

    def best(self, value: str, beat: float = -1.0) -> tuple[float, str] | None:
        """(ratio, name) of the most similar name, the greatest of equals; None if none reaches ``beat``."""
        total = self.size + len(value)
        most = np.where(total > 0, 2.0 * self.shared(value) / np.maximum(total, 1), 1.0)
        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(value)
        best = (beat, "") if beat >= 0 else (-1.0, "")
        found = None

        def look(i: int) -> None:
            nonlocal best, found
            matcher.set_seq1(self.names[i])
            own = (matcher.ratio(), self.names[i])
            if found is None and own[0] >= best[0] or found is not None and own > best:
                best = found = own

        first = int(most.argmax())
        look(first)
        left = np.flatnonzero(most >= best[0])
        if 0 < len(value) < 64:
            some = total[left] > 0
            most[left[some]] = 2.0 * self.subsequence(value, left[some]) / total[left[some]]
        left = left[np.lexsort((-left, -most[left]))]  # best bound first, greatest name first
        for i in left.tolist():
            if most[i] < best[0]:
                break
            if i != first:
                look(i)
        return found


def _length_blocks(names: DataFrame, name_rows: int) -> list[tuple[int, int, int, int]]:
    """(first block, parts, least length, greatest length) of every range of lengths, shortest first."""
    counts = sorted((r.n, r.c) for r in names.groupBy(F.length("_n").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect())
    out: list[tuple[int, int, int, int]] = []
    block, lo, size = 0, None, 0
    for i, (length, count) in enumerate(counts):
        lo = length if lo is None else lo
        size += count
        if size >= name_rows or i == len(counts) - 1:
            parts = -(-size // (2 * name_rows))
            out.append((block, parts, lo, length))
            block, lo, size = block + parts, None, 0
    return out


def _ratio_matches(values: DataFrame, names: DataFrame, name_rows: int) -> DataFrame:
    """Best ratio of every value: its own length's block first, then the blocks that can still beat it."""
    ranges = _length_blocks(names, name_rows)
    if not ranges:
        return values.sparkSession.createDataFrame([], _MATCH_DDL)
    groups = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("block", "parts", "lo", "hi"), strict=True)])
                       for r in ranges])
    length = F.length("_n")
    own = F.filter(groups, lambda g: (g["lo"] <= length) & (length <= g["hi"]))[0]
    slices = max(1, -(-values.count() // VALUE_ROWS))
    dealt = (names.withColumn("_g", own).select("_n", (F.col("_g.block") + F.pmod(F.xxhash64("_n"), F.col("_g.parts")))
                                                .cast("int").alias("_block"))
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))

    def match(v: pa.Table, n: pa.Table) -> pa.Table:
        if not len(v) or not len(n):
            return _MATCH.empty_table()
        block, out = NameBlock(n["_n"].to_pylist()), []
        for value, beat in zip(v["_id"].to_pylist(), v["_beat"].to_pylist(), strict=True):
            found = block.best(value, beat)
            if found:
                out.append({"value": value, "name": found[1], "score": found[0]})
        return pa.Table.from_pylist(out, _MATCH)

    def meet(v: DataFrame) -> DataFrame:
        keyed = v.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int"))
        return keyed.groupBy("_block", "_part").cogroup(dealt.groupBy("_block", "_part")).applyInArrow(match, _MATCH_DDL)

    size = F.length("_id")
    away = F.transform(groups, lambda g: F.struct(
        F.greatest(g["lo"] - size, size - g["hi"], F.lit(0)).alias("far"), g["block"].alias("block"), g["parts"].alias("parts")))
    home = values.withColumn("_g", F.array_min(away)).select(
        "_id", F.lit(-1.0).alias("_beat"), F.explode(F.sequence(F.col("_g.block"), F.col("_g.block") + F.col("_g.parts") - 1))
        .alias("_block"))
    first = meet(home)
    if len(ranges) == 1:
        return first
    from tessera.session import cut_lineage
    first = cut_lineage(first.groupBy("value").agg(F.max(F.struct("score", "name")).alias("b")).select(
        "value", "b.name", "b.score"))
    v = first.select(F.col("value").alias("_id"), F.col("score").alias("_beat")).withColumn("_home", F.array_min(
        away)["block"])
    near = F.least(F.greatest(size, F.col("_r.lo")), F.col("_r.hi"))  # the length of the range that suits the value best
    reach = F.when(size + near > 0, 2.0 * F.least(size, near) / (size + near)).otherwise(F.lit(1.0))
    rest = (v.withColumn("_r", F.explode(groups)).filter((F.col("_r.block") != F.col("_home")) & (reach >= F.col("_beat")))
            .select("_id", "_beat", F.explode(F.sequence(F.col("_r.block"), F.col("_r.block") + F.col("_r.parts") - 1))
                    .alias("_block")))
    return first.unionByName(meet(rest))


def nearest_name(values: DataFrame, taxonomy: DataFrame, value_col: str = "value", name_col: str = "component",
                 method: str = "difflib", name_rows: int = NAME_ROWS) -> DataFrame:
    """Closest taxonomy entry for every distinct value.

    Case-sensitive, no cutoff; ties go to the lexicographically greatest name.
    Returns ``(value, name, score)``; ``score`` lets callers apply a cutoff.
    ``method`` is ``difflib`` (ratio) or ``levenshtein`` (negative distance).
    """
    v = values.select(F.col(value_col).cast("string").alias("_id")).dropna().distinct()
    t = taxonomy.select(F.col(name_col).cast("string").alias("_n")).dropna().distinct()
    if method == "levenshtein":
        chunks = max(1, -(-t.count() // name_rows))
        # every value meets every chunk of names: one row per chunk, keyed by its number
        names = (t.groupBy(F.pmod(F.xxhash64("_n"), F.lit(chunks)).alias("_chunk"))
                 .agg(F.sort_array(F.collect_list("_n")).alias("_names")))
        met = v.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(
            names, "_chunk")
        scored = F.transform("_names", lambda n: F.struct(
            (-F.levenshtein(F.col("_id"), n)).cast("double").alias("score"), n.alias("name")))
        local = met.select(F.col("_id").alias("value"), F.array_max(scored).alias("_b")).select(
            "value", "_b.name", "_b.score")
    else:
        from tessera.session import cut_lineage
        local = _ratio_matches(cut_lineage(v), t, name_rows)
    best = F.struct("score", "name")
    return local.groupBy("value").agg(F.max(best).alias("_b")).select(
        "value", F.col("_b.name").alias("name"), F.col("_b.score").alias("score"))


def validate_replies(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Parse each reply leniently and validate it.

    Each reply is parsed once and its three fields taken in one lookup
    (``field_checks``). The checks are produced by a one-row ``inline`` so a
    later filter on ``ok`` stays above them instead of being pushed down with
    the parse copied into every predicate.
    """
    keep_last_json_key(replies.sparkSession)
    checks = EX.field_checks(EX.parse_json_lenient(F.col(reply_col)))
    keep = [c for c in replies.columns if c not in ("parsed", "area", "severity", "kind", "ok", "reason")]
    return replies.select(*keep, F.inline(checks))


def _scored(fn: Callable[[pd.DataFrame], pd.Series], pdf: pd.DataFrame) -> tuple[list, list[bool]]:
    """(values, failed) of a batch; one that raises is halved until its failing rows are alone."""
    if not len(pdf):
        return [], []
    try:
        vals = list(fn(pdf))
        if len(vals) != len(pdf):
            raise ValueError(f"{len(vals)} values for {len(pdf)} rows")
        return vals, [False] * len(pdf)
    except Exception:  # noqa: BLE001 - remote model failure -> null + flag, for the rows that cause it
        if len(pdf) == 1:
            return [None], [True]
    half = len(pdf) // 2
    (a, x), (b, y) = _scored(fn, pdf.iloc[:half]), _scored(fn, pdf.iloc[half:])
    return a + b, x + y


def score_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], out_col: str = "score",
               out_type: str = "string") -> DataFrame:
    """Apply a user batch function (judge, namer) to every row (F2).

    ``fn`` receives a pandas batch and returns one value per row. A batch that
    raises, or returns another number of values, is halved and tried again
    until the failing rows are alone: those get null and
    ``<out_col>_failed = true``, all others their value. One bad row among n
    costs about ``2 log2(n)`` more calls.
    """
    schema = f"{df.schema.simpleString()[7:-1]}, {out_col} {out_type}, {out_col}_failed boolean"

    def run(it):
        for pdf in it:
            vals, failed = _scored(fn, pdf)
            yield pdf.assign(**{out_col: pd.Series(vals, index=pdf.index, dtype=object), f"{out_col}_failed": failed})

    return df.mapInPandas(run, schema)


def judge_labels(replies: DataFrame, reply_col: str = "reply", threshold: int = 5) -> DataFrame:
    """Judge reply -> 0/1 at ``threshold``; unreadable -> 0, flagged."""
    keep_last_json_key(replies.sparkSession)
    s = EX.judge_score(F.col(reply_col))
    return replies.withColumn("parsed", s.isNotNull()).withColumn("judge_good", T.binarise_score(s, threshold))


def prior_for(names: DataFrame, reports: DataFrame, mapping: dict[str, str] | None = None,
              name_col: str = "value") -> DataFrame:
    """Component prior for free-text names (F3: the ``component_prior`` tool as a join).

    Each name is matched to its closest component (J15), then joined to the
    per-component prior (A11).
    """
    from tessera.operators.stats import component_prior
    from tessera.sources.readers import taxonomy
    match = nearest_name(names, taxonomy(reports), name_col, "component")
    prior = component_prior(reports, mapping)
    return match.join(prior, F.col("name") == F.col("component"), "left").drop("name")


def catalog_conformance(extractions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per catalog field with allowed values: replies whose value is allowed.

    Which fields are checked is up to the catalog, a dimension table with one
    row per field: every field that it lists values for and that the extractions
    have as a column. The extractions are unpivoted to ``(field, value)``; the
    join's strategy is left to the optimizer.
    """
    listed = catalog.filter(F.col("allowed").isNotNull())
    allowed = listed.select("field", F.explode("allowed").alias("value")).distinct().withColumn("_ok", F.lit(True))
    fields = sorted({r.field for r in listed.select("field").collect()} & set(extractions.columns))
    if not fields:
        return extractions.sparkSession.createDataFrame([], "field string, n long, n_allowed long, n_missing long")
    long = extractions.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("_fv")
    ).select("_fv.*")
    j = long.join(allowed, ["field", "value"], "left")
    return j.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("n_allowed"),
                                  F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"))
