"""Hard negatives: exact mining with segment summaries as score bounds.

Every vector is cut into segments, first few and long, then more and shorter. A
segment is summarised by its mean and its deviation (the root of the summed
squared distances from the mean). Over a segment of w components the inner
product of x and y is w * mean * mean plus the product of the residuals, which
lies between plus and minus deviation * deviation. Summed over the segments this
bounds the score from both sides; written as one vector of scaled means and
deviations per row, a bound for a whole block is one matrix product over a few
numbers a row instead of all components. Rows that no anchor of a block can
still use, by the bounds of one level, are not refined; what is left after the
last level is scored exactly. Nothing is approximated: a row is dropped only
when its bounds prove that it cannot enter a list.

Two rounds over a grid of (rows, anchors) blocks: the positives of an anchor are
searched among the rows of its label, the negatives in the score windows that
the positives set. The grid is dealt by Spark: rows meet every block of anchors
and anchors every block of rows, no vector passes the driver, and a label that
holds a third of all rows is cut into as many blocks as its size asks for.

Scores are integers (each component becomes floor(scale * x)) and exact: float64
products while they stay below 2**53, Python's integers beyond; a score past the
range of a long is the end of that range.

Defined results: rows whose id or label is null, or whose vector is null or
holds a null or non-finite component take no part. A shorter vector counts as
padded with zeros; zero and empty vectors take part. A repeated row counts once;
rows of an anchor's own id are never its positives or negatives. Ties go to the
smaller id. An anchor without positives, and an empty table, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width
from tessera.llm.vectorrows import finite, matrix
from tessera.session import cut_lineage

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
#: Rows or anchors of one block, and the least rows worth a block of their own.
BLOCK, SMALL = 1 << 16, 1 << 12
#: Rows and anchors whose scores are held at once.
TILE_ROWS, TILE_ANCHORS = 4096, 512
#: Segments of each level of summaries.
LEVELS = (4, 16)
#: Share of pairs above which a tile is scored as one product.
DENSE = 0.1
_EXACT = float(1 << 39)
_LONG = (1 << 63) - 1
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x.astype(np.float64) * scale))


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled mean and deviation of every segment: (rows, segments) each."""
    edges = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    means, spread = [], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = x[:, lo:hi]
        mean = part.mean(1) if hi > lo else np.zeros(len(x))
        means.append(mean * np.sqrt(hi - lo))
        spread.append(np.sqrt(((part - mean[:, None]) ** 2).sum(1)))
    return np.stack(means, axis=1), np.stack(spread, axis=1)


class Block:
    """Integer vectors of a block with their ids and the summaries of every level."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.levels = [summaries(x, s) for s in LEVELS if s < x.shape[1]]

    def part(self, rows) -> Block:
        out = object.__new__(Block)
        out.x, out.ids = self.x[rows], self.ids[rows]
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs, as float64 or as Python's integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < _EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG)


def _possible(a: Block, b: Block, low: np.ndarray, high: np.ndarray, fits: np.ndarray):
    """Anchors, rows and the pairs of them whose bounds reach the anchors' windows."""
    rows, cols, alive = np.arange(len(a.ids)), np.arange(len(b.ids)), fits
    for (am, ad), (bm, bd) in zip(a.levels, b.levels, strict=True):
        mean, slack = am[rows] @ bm[cols].T, ad[rows] @ bd[cols].T
        room = 0.5 + 1e-9 * (np.abs(mean) + slack)
        alive = alive & (mean + slack + room >= low[rows][:, None]) & (mean - slack - room <= high[rows][:, None])
        keep_rows, keep_cols = alive.any(1), alive.any(0)
        rows, cols, alive = rows[keep_rows], cols[keep_cols], alive[keep_rows][:, keep_cols]
        if not len(rows):
            break
    return rows, cols, alive


def _tile(a: Block, b: Block, low: np.ndarray, high: np.ndarray, fits: np.ndarray):
    """(anchors, rows, exact scores, which of them are possible) of a tile."""
    rows, cols, alive = _possible(a, b, low, high, fits)
    if not alive.size:
        return rows, cols, np.zeros(alive.shape), alive
    x, y = a.x[rows], b.x[cols]
    small = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < _EXACT
    if small and alive.mean() < DENSE:
        score = np.zeros(alive.shape)
        i, j = np.nonzero(alive)
        score[i, j] = np.einsum("ij,ij->i", x[i], y[j])
        return rows, cols, score, alive
    return rows, cols, _scores(x, y), alive


def _least_first(score: np.ndarray, ok: np.ndarray, k: int):
    """By anchor the k best places of a tile whose rows are in id order (ties: the first)."""
    n = score.shape[1]
    if score.dtype == object:
        out = []
        for s, m in zip(score, ok, strict=True):
            j = np.flatnonzero(m)
            out.append(sorted(j.tolist(), key=lambda p, s=s: (-s[p], p))[:k])
        return out
    key = np.where(ok, score * n - np.arange(n), -np.inf)
    if n > k:
        place = np.argpartition(key, n - k, axis=1)[:, -k:]
    else:
        place = np.broadcast_to(np.arange(n), score.shape)
    own = np.take_along_axis(key, place, axis=1)
    order = np.argsort(-own, axis=1)
    place, own = np.take_along_axis(place, order, axis=1), np.take_along_axis(own, order, axis=1)
    return [p[np.isfinite(o)].tolist() for p, o in zip(place, own, strict=True)]


def scan(anchors: Block, rows: Block, fits, windows: list[tuple[np.ndarray, np.ndarray]], k: int):
    """The k best rows inside each window of each anchor: lists [window][anchor] of (-score, id).

    ``fits(anchors, rows)`` is a mask of the pairs to look at; a window is (least, greatest) score by anchor.
    """
    best = [[[] for _ in anchors.ids] for _ in windows]
    order = np.argsort(rows.ids, kind="stable")
    for at in range(0, len(order), TILE_ROWS):
        there = order[at:at + TILE_ROWS]
        b = rows.part(there)
        for lo in range(0, len(anchors.ids), TILE_ANCHORS):
            here = np.arange(lo, min(len(anchors.ids), lo + TILE_ANCHORS))
            a = anchors.part(here)
            # what a window still needs: more than its k-th best so far, ids only grow
            floor = [np.array([max(w[0][i], -h[i][-1][0] + 1) if len(h[i]) == k else w[0][i] for i in here],
                              dtype=np.float64) for w, h in zip(windows, best, strict=True)]
            low = np.min(floor, axis=0)
            high = np.max([w[1][here] for w in windows], axis=0).astype(np.float64)
            i, j, score, alive = _tile(a, b, low, high, fits(here, there))
            if not alive.size:
                continue
            for w, h in zip(windows, best, strict=True):
                ok = alive & (score >= w[0][here[i]][:, None]) & (score <= w[1][here[i]][:, None])
                for t, places in enumerate(_least_first(score, ok, k)):
                    if places:
                        own = h[here[i[t]]]
                        own += [(-int(score[t, q]), int(b.ids[j[q]])) for q in places]
                        own.sort()
                        del own[k:]
    return best


_PAIR = pa.schema([("aid", pa.int64()), ("pid", pa.int64()), ("pscore", pa.int64()), ("id", pa.int64()),
                   ("score", pa.int64())])
_PAIR_DDL = "aid long, pid long, pscore long, id long, score long"


def _blocks(rows: pa.Table, anchors: pa.Table, width: int, scale: float) -> tuple[Block, Block]:
    return (Block(integers(matrix(anchors["vector"], width), scale), anchors["id"].to_numpy()),
            Block(integers(matrix(rows["vector"], width), scale), rows["id"].to_numpy()))


def _block_counts(n: int, asked: int, width: int) -> tuple[int, int]:
    """Blocks of rows and of anchors for a part of the grid."""
    return max(1, -(-n // BLOCK), min(width, n // SMALL)), max(1, -(-asked // BLOCK))


def mine_negatives(vectors: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, embedding) that ``asks`` holds for.

    A negative has another label and ``low`` to ``high`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    at_hand = cut_lineage(
        vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("vector"),
                F.coalesce(asks, F.lit(False)).alias("asks"))
        .withColumns({"c1": F.xxhash64("vector"), "c2": F.xxhash64(F.lit(1), "vector")})
        .dropDuplicates(["id", "label", "c1", "c2"]).drop("c1", "c2"))
    n, asked, width = at_hand.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector"))).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    slots = shuffle_width(spark)
    rows = at_hand.select("id", "label", "vector")
    anchors = at_hand.filter("asks").select(  # new names, so that rows and anchors can be told apart
        F.monotonically_increasing_id().alias("aid"), *[F.col(c).alias(c) for c in ("id", "label", "vector")])
    deal = F.xxhash64("id", "vector")

    # labels cut into blocks: over n / 4096 or BLOCK rows each, so at most 4,096 or n / BLOCK; others are one block
    large = max(2 * SMALL, min(BLOCK, n // 4096))
    split = [(r.label, *_block_counts(r.n, r.asked, slots)) for r in
             at_hand.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
             .filter(F.col("n") > large).collect()]
    kind = at_hand.schema["label"].dataType.simpleString()
    cuts = spark.createDataFrame(split, f"label {kind}, row_blocks int, anchor_blocks int")

    def by_label(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(cuts), "label", "left").fillna(1, ["row_blocks", "anchor_blocks"])

    own, every = F.pmod(deal, "row_blocks"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = by_label(rows).withColumns({"rb": own.cast("int"), "ab": every("anchor_blocks")})
    right = by_label(anchors).withColumns({"ab": F.pmod(deal, "anchor_blocks").cast("int")}).withColumn(
        "rb", every("row_blocks"))

    def same_label(r: pa.Table, a: pa.Table) -> pa.Table:
        if not len(r) or not len(a):
            return _PAIR.empty_table()
        x, y = _blocks(r, a, width, scale)
        free = np.full(len(x.ids), -np.inf), np.full(len(x.ids), np.inf)
        best = scan(x, y, lambda i, j: x.ids[i][:, None] != y.ids[j][None, :], [free], positives)[0]
        aid = a["aid"].to_pylist()
        return pa.Table.from_pylist([{"aid": aid[i], "pid": p, "pscore": -s, "id": None, "score": None}
                                     for i, own in enumerate(best) for s, p in own], _PAIR)

    keys = ["label", "rb", "ab"]
    first = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(same_label, _PAIR_DDL)
    place = F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("pscore"), "pid"))
    chosen = (first.select("aid", "pid", "pscore").withColumn("place", place).filter(F.col("place") <= positives)
              .groupBy("aid").agg(F.collect_list(F.struct("pid", "pscore")).alias("positives")))

    row_blocks, anchor_blocks = _block_counts(n, asked, slots)
    left = rows.withColumns({"rb": F.pmod(deal, F.lit(row_blocks)).cast("int"),
                             "ab": F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))})
    right = anchors.join(chosen, "aid").withColumns({
        "ab": F.pmod(deal, F.lit(anchor_blocks)).cast("int"),
        "rb": F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))})

    def other_label(r: pa.Table, a: pa.Table) -> pa.Table:
        if not len(r) or not len(a):
            return _PAIR.empty_table()
        x, y = _blocks(r, a, width, scale)
        codes = {v: i for i, v in enumerate(set(r["label"].to_pylist()) | set(a["label"].to_pylist()))}
        xl, yl = (np.array([codes[v] for v in t["label"].to_pylist()]) for t in (a, r))
        found = a["positives"].to_pylist()
        windows = []
        for p in range(positives):  # integer bounds of the window; an anchor with fewer positives has an empty one
            s = [row[p]["pscore"] if p < len(row) else None for row in found]
            big = any(v is not None and abs(v) > _EXACT for v in s)
            windows.append(tuple(np.array(w, dtype=object if big else np.float64) for w in (
                [1 if v is None else -(-low * v // 100) for v in s], [0 if v is None else high * v // 100 for v in s])))
        def fits(i, j):
            return (xl[i][:, None] != yl[j][None, :]) & (x.ids[i][:, None] != y.ids[j][None, :])
        best = scan(x, y, fits, windows, negatives)
        aid = a["aid"].to_pylist()
        return pa.Table.from_pylist(
            [{"aid": aid[i], "pid": found[i][p]["pid"], "pscore": found[i][p]["pscore"], "id": q, "score": -s}
             for p, lists in enumerate(best) for i, own in enumerate(lists) for s, q in own], _PAIR)

    second = left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(other_label, _PAIR_DDL)
    rank = F.row_number().over(Window.partitionBy("aid", "pid", "pscore").orderBy(F.desc("score"), "id"))
    return (second.withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
            .select("anchor_id", F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"),
                    F.col("score").alias("negative_score")))
