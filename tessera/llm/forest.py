"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

The index: every distinct vector gets one hash string of 64 sign bits per tree
(random hyperplanes over the vector and one more coordinate that lifts all
vectors to the same length, so that the largest inner product is the smallest
angle). A tree is the sorted array of its strings; an inner node is a prefix,
its entries a contiguous range. The arrays lie in slices of about ``SLICE``
entries, cut at quantiles; a string that fills several slices is dealt over all
of them by class.

A search descends in every tree to the longest prefix that its string shares
and ascends in all trees together, one tree's level at a time, until the ranges
hold a given number of entries; the slices that the ranges meet score them
exactly. That number is not a constant: it is the least one that finds
``recall`` of the true neighbours of ``PROBES`` sampled queries, which one pass
over all vectors finds exactly. Where the ascent ends is read off a sketch (the
strings of one class in n / ``SKETCH``, at most about 2 * ``SKETCH`` of them, so
its broadcast is bounded by 16 bytes * ``SKETCH`` * trees); the index itself
holds every row, and a range is always searched whole.

Equal vectors are one class: indexed and searched once, with their k + 1 least
ids, so that a vector which a third of all rows share costs one entry.

Defined results: rows whose id or vector is null, or whose vector is zero, empty
or holds a null or non-finite component take no part. A shorter vector counts as
padded with zeros. A repeated row counts once; an id with several vectors is
found at its best one, and as a query gets a list for each. Ties go to the
smaller id. Fewer candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vectorrows import finite, matrix
from tessera.session import cut_lineage

K = 20
TREES = 32
BITS = 64
SLICE = 1 << 14
SKETCH = 1 << 15
PROBES = 128
RECALL = 0.95
SEED = 20
#: Scores of a block of queries against a range that are held at once.
CELLS = 1 << 22
RESULT = "query_id long, rank int, vec_id long, score double"


@lru_cache(maxsize=2)
def _planes(width: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width + 1, trees * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, longest: float, trees: int, lift: bool) -> np.ndarray:
    """Sign-bit strings (trees, rows) as uint64, first bit highest."""
    planes = _planes(x.shape[1], trees)
    y = x.astype(np.float64) / longest
    signs = (y.astype(np.float32) @ planes[:-1])
    if lift:
        signs += np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None].astype(np.float32) * planes[-1]
    bits = np.packbits((signs > 0).reshape(len(x), trees, BITS), axis=2)
    return np.ascontiguousarray(bits).view(">u8")[:, :, 0].astype(np.uint64).T


def _mask(depth: int) -> np.uint64:
    return np.uint64(((1 << depth) - 1) << (BITS - depth))


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    both = np.zeros(np.broadcast(a, b).shape, np.int64)
    for depth in range(1, BITS + 1):
        both += (a ^ b) & _mask(depth) == 0
    return both


def _counts(sketch: np.ndarray, strings: np.ndarray, depth: int) -> np.ndarray:
    """Sketch entries (trees, rows) that share ``depth`` bits with each string."""
    low = strings & _mask(depth)
    high = low | ~_mask(depth)
    return np.stack([np.searchsorted(s, h, "right") - np.searchsorted(s, w, "left")
                     for s, w, h in zip(sketch, low, high, strict=True)])


def ascent(sketch: np.ndarray, strings: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, entries held after each tree has ascended to it), from the longest prefix up."""
    before = np.zeros(strings.shape, np.int64)
    for depth in range(BITS, -1, -1):
        now = _counts(sketch, strings, depth)
        yield depth, before.sum(0) + np.cumsum(now - before, axis=0)
        before = now


def stops(sketch: np.ndarray, strings: np.ndarray, budget: float) -> np.ndarray:
    """Prefix length (trees, rows) at which each tree's ascent ends for each string."""
    depth = np.zeros(strings.shape, np.int64)
    left = np.arange(strings.shape[1])
    trees = np.arange(len(strings))[:, None]
    for level, held in ascent(sketch, strings):
        hit = held[:, left] >= budget
        done = hit.any(0)
        last = hit.argmax(0)[done]
        depth[:, left[done]] = np.where(trees <= last, level, level + 1)
        left = left[~done]
        if not len(left) or level == 0:
            break
    depth[1:, left] = 1  # the whole of one tree is everything
    return depth


def needed(sketch: np.ndarray, strings: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Entries held just before each neighbour is met; shared: (neighbours, trees), a string each."""
    trees = len(strings)
    met = ((BITS - shared) * trees + np.arange(trees)).min(1)
    held = np.concatenate([h for _, h in ascent(sketch, strings)])  # (steps, neighbours)
    return np.where(met > 0, held[np.maximum(met - 1, 0), np.arange(len(met))], 0)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores that may be among each row's k largest."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        return np.nonzero(score >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
    return np.nonzero(np.ones(score.shape, bool))


def _top(q: np.ndarray, v: np.ndarray, key: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of each query's k best of ``v``; a pair's score does not depend on its block."""
    out = []
    step = max(1, CELLS // max(1, len(v)))
    for at in range(0, len(q), step):
        part = q[at:at + step]
        i, j = _best(part @ v.T, k)
        s = np.einsum("ij,ij->i", part[i], v[j])
        order = np.lexsort((key[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        cut = np.searchsorted(i, np.arange(len(part) + 1))
        out += [(j[lo:min(hi, lo + k)], s[lo:min(hi, lo + k)]) for lo, hi in zip(cut, cut[1:], strict=False)]
    return out


def vector_classes(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """Distinct vectors: cls, c1, c2 (hash of the vector), ids (k + 1 least), asks, vector."""
    keyed = (rows.withColumns({"c1": F.xxhash64("vector"), "c2": F.xxhash64(F.lit(1), "vector"), "asks": asks})
             .dropDuplicates(["id", "c1", "c2"]))
    place = F.row_number().over(Window.partitionBy("c1", "c2", "asks").orderBy("id"))
    least = (keyed.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("c1", "c2")
             .agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"),
                  F.first("vector").alias("vector")))
    return cut_lineage(least).withColumn("cls", F.monotonically_increasing_id())


class Forest:
    """What tasks need to place entries and queries: the sketch, the budget and the slices."""

    def __init__(self, sketch: np.ndarray, n: int, width: int, longest: float, budget: float):
        self.sketch, self.width, self.longest, self.budget = sketch, width, longest, budget
        self.trees = len(sketch)
        self.per_tree = max(1, min(-(-n // SLICE), max(1, sketch.shape[1] // 4)))
        at = np.arange(1, self.per_tree) * sketch.shape[1] // self.per_tree
        self.cuts = sketch[:, at]

    def entries(self, x: np.ndarray, cls: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slice, rows, strings) of the entries of a block of vectors."""
        strings = hash_strings(x, self.longest, self.trees, True)
        for t, s in enumerate(strings):
            low, high = np.searchsorted(self.cuts[t], s, "left"), np.searchsorted(self.cuts[t], s, "right")
            own = low + cls % (high - low + 1)
            order = np.lexsort((s, own))
            cut = np.flatnonzero(np.diff(own[order], prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
                pick = order[lo:hi]
                yield t * self.per_tree + int(own[pick[0]]), pick, s[pick]

    def ranges(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(slice, rows, first string, last string) of the ranges of a block of queries."""
        strings = hash_strings(x, self.longest, self.trees, False)
        depth = stops(self.sketch, strings, self.budget)
        for t, s in enumerate(strings):
            mask = np.array([_mask(d) for d in range(BITS + 1)], np.uint64)[depth[t]]
            low, high = s & mask, s | ~mask
            first, last = np.searchsorted(self.cuts[t], low, "left"), np.searchsorted(self.cuts[t], high, "right")
            n = last - first + 1
            row = np.repeat(np.arange(len(s)), n)
            own = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            order = np.argsort(own, kind="stable")
            cut = np.flatnonzero(np.diff(own[order], prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
                pick = row[order[lo:hi]]
                yield t * self.per_tree + int(own[order[lo]]), pick, low[pick], high[pick]


_PART = pa.schema([("slice", pa.int64()), ("asks", pa.bool_()), ("cls", pa.binary()), ("low", pa.binary()),
                   ("high", pa.binary()), ("vec", pa.binary())])
_PART_DDL = "slice long, asks boolean, cls binary, low binary, high binary, vec binary"
_FOUND = pa.schema([("query", pa.int64()), ("cls", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
_FOUND_DDL = "query long, cls array<long>, score array<double>"


def _search_slice(group: pa.Table, width: int, dtype: str, k: int) -> pa.Table:
    """One slice: the k best of each range that meets it."""
    def gather(rows, name, kind):
        return np.concatenate([np.frombuffer(b, kind) for b in rows[name].to_pylist()])
    asks = group["asks"].to_numpy()
    own, met = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
    if not len(own) or not len(met):
        return _FOUND.empty_table()
    strings, cls = gather(own, "low", np.uint64), gather(own, "cls", np.int64)
    order = np.lexsort((cls, strings))
    strings, cls = strings[order], cls[order]
    v = gather(own, "vec", dtype).reshape(-1, width)[order].astype(np.float64)
    low, high, query = gather(met, "low", np.uint64), gather(met, "high", np.uint64), gather(met, "cls", np.int64)
    q = gather(met, "vec", dtype).reshape(-1, width)
    first, last = np.searchsorted(strings, low, "left"), np.searchsorted(strings, high, "right")
    order = np.lexsort((last, first))
    cut = np.flatnonzero((np.diff(first[order], prepend=-1) != 0) | (np.diff(last[order], prepend=-1) != 0))
    who, places, scores = [], [], []
    for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
        rows = order[lo:hi]
        a, b = first[rows[0]], last[rows[0]]
        if a == b:
            continue
        for r, (j, s) in zip(rows, _top(q[rows].astype(np.float64), v[a:b], cls[a:b], k), strict=True):
            who.append(query[r])
            places.append(cls[a:b][j])
            scores.append(s)
    return pa.table({"query": pa.array(who, pa.int64()), "cls": pa.array(places, pa.list_(pa.int64())),
                     "score": pa.array(scores, pa.list_(pa.float64()))}, _FOUND)


def _calibrate(classes: DataFrame, sketch: np.ndarray, n: int, width: int, longest: float, k: int, trees: int,
               recall: float) -> float:
    """Sketch entries that an ascent must hold to find ``recall`` of the true neighbours of sampled queries."""
    least = 4 * k * trees * sketch.shape[1] / max(1, n)
    asking = classes.filter("asks")
    step = max(1, asking.count() // PROBES)
    probes = (asking.filter(F.pmod(F.xxhash64("cls"), F.lit(step)) == 0).orderBy("cls").limit(2 * PROBES)
              .select("cls", "vector").toArrow())
    if not len(probes):
        return least
    q, own = matrix(probes["vector"], width).astype(np.float64), probes["cls"].to_numpy()
    schema = pa.schema([("probe", pa.int32()), ("cls", pa.int64()), ("score", pa.float64()), ("strings", pa.binary())])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, bytes]]] = [[] for _ in q]
        for batch in batches:
            x, cls = matrix(batch.column("vector"), width), batch.column("cls").to_numpy()
            for at in range(0, len(x), 4096):
                part, ids = x[at:at + 4096].astype(np.float64), cls[at:at + 4096]
                if not len(part):
                    continue
                best = _top(q, part, ids, k + 1)
                strings = hash_strings(part, longest, trees, True)
                for i, (j, s) in enumerate(best):
                    new = [(-score, int(ids[p]), strings[:, p].tobytes()) for p, score in zip(j, s, strict=True)
                           if ids[p] != own[i]]
                    held[i] = sorted(held[i] + new)[:k]
        yield pa.RecordBatch.from_pylist([{"probe": i, "cls": c, "score": -s, "strings": b}
                                          for i, rows in enumerate(held) for s, c, b in rows], schema)

    best = classes.select("cls", "vector").mapInArrow(truth, "probe int, cls long, score double, strings binary")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cls"))
    true = best.withColumn("place", place).filter(F.col("place") <= k).select("probe", "strings").toArrow()
    if not len(true):
        return least
    which = true["probe"].to_numpy()
    found = np.stack([np.frombuffer(b, np.uint64) for b in true["strings"].to_pylist()])
    strings = hash_strings(q, longest, trees, False)[:, which]
    need = np.sort(needed(sketch, strings, shared_prefix(found, strings.T)))
    return max(least, float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1)


def nearest(vectors: DataFrame, asks: Column, k: int = K, trees: int = TREES, recall: float = RECALL,
            sketch_rows: int = SKETCH) -> DataFrame:
    """The k nearest rows (vec_id, embedding) of every row that ``asks`` holds for: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    dtype = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    kind = "array<float>" if dtype == "float32" else "array<double>"
    rows = (vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))
                           & F.exists("embedding", lambda x: x != 0))
            .select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vector"),
                    F.coalesce(asks, F.lit(False)).alias("asks")))
    classes = vector_classes(rows, F.col("asks"), k)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, width, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], RESULT)

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                s = hash_strings(matrix(batch.column("vector"), width), longest, trees, True)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(s).tobytes()], pa.binary())], ["s"])

    picked = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(max(1, n // sketch_rows))) == 0)
    parts = [np.frombuffer(r.s, np.uint64).reshape(trees, -1)
             for r in picked.select("vector").mapInArrow(strings_of, "s binary").collect()]
    sketch = np.sort(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((trees, 0), np.uint64)
    budget = _calibrate(classes, sketch, n, width, longest, k, trees, recall)
    forest = spark.sparkContext.broadcast(Forest(sketch, n, width, longest, budget))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            x, cls, ask = (matrix(batch.column("vector"), width), batch.column("cls").to_numpy(),
                           batch.column("asks").to_numpy(zero_copy_only=False))
            if not len(x):
                continue
            out = [(s, False, cls[p].tobytes(), a.tobytes(), b"", x[p].tobytes()) for s, p, a in f.entries(x, cls)]
            if ask.any():
                q, who = x[ask], cls[ask]
                out += [(s, True, who[p].tobytes(), a.tobytes(), b.tobytes(), q[p].tobytes())
                        for s, p, a, b in f.ranges(q)]
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in
                                                  zip(zip(*out[at:at + 256], strict=True), _PART.types, strict=True)],
                                                 schema=_PART)

    placed = classes.select("cls", "asks", "vector").mapInArrow(place, _PART_DDL)
    found = placed.groupBy("slice").applyInArrow(lambda g: _search_slice(g, width, dtype, k), _FOUND_DDL)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cls = matrix(batch.column("vector"), width).astype(np.float64), batch.column("cls")
            own = np.einsum("ij,ij->i", x, x)
            yield pa.RecordBatch.from_arrays([cls, cls, pa.array(own)], ["query", "cls", "score"])

    copies = (classes.filter("asks").filter(F.size("ids") > 1).select("cls", "vector")
              .mapInArrow(itself, "query long, cls long, score double"))
    pairs = (found.select("query", F.explode(F.arrays_zip("cls", "score")).alias("x"))
             .select("query", "x.cls", "x.score").unionByName(copies).groupBy("query", "cls")
             .agg(F.max("score").alias("score")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    named = (pairs.join(classes.select("cls", "ids"), "cls").withColumn("first", F.get("ids", F.lit(0)))
             .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
             .select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id")
             .agg(F.max("score").alias("score")))
    ranked = named.withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    queries = (rows.filter("asks").select("id", F.xxhash64("vector").alias("c1"),
                                          F.xxhash64(F.lit(1), "vector").alias("c2")).distinct()
               .join(classes.filter("asks").select("c1", "c2", F.col("cls").alias("query")), ["c1", "c2"]))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return (queries.join(lists, "query").select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), "x.score"))
