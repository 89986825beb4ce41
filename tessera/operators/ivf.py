"""Approximate nearest neighbours over a stored inverted file.

``build_index`` cuts the vector space by k-means into lists and writes every row
under its nearest centre, one partition of the table per list; the centres and
the number of lists to probe are stored beside it. ``search_index`` sends a
query to its nearest lists only and ranks their rows exactly.

How many lists a query must probe is measured when the index is built: sampled
rows are searched exactly, and the least number of lists that holds ``recall``
of their true neighbours is stored. On clustered vectors that is a few lists; on
vectors without any structure it is a large share of them, and the figure says
so, where a fixed number would silently lose neighbours.

The centres are fitted on a bounded sample (``SAMPLE_PER_LIST`` rows a list); the
index holds every row. There are at most ``MAX_LISTS`` lists, which bounds what
is broadcast (the centres, and for every list the pieces that ask for it).

Lists that lie near each other form groups of at most ``CELL_ROWS`` rows, and
queries whose nearest lists do form pieces of about ``CELL_QUERIES``. A query's
vector travels once to every group of which it probes a list, with a bit for each
list, and a list once to every piece that asks for its group. So on clustered
vectors hardly anything is sent twice, and on vectors without structure rows
times rows over cell size, not every query to every list. A list that holds a third of all rows is
many packed blocks of ``BLOCK_ROWS`` rows and many cells; a task holds one cell
of both sides, whatever the size of the list or of the table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.topk import top_k, unit_rows, vector_matrix
from tessera.operators.vectors import _KNN, _KNN_DDL, MIN_BLOCK_QUERIES, best_k, knn_join, vector_rows
from tessera.session import parallelism, remove_folder, write_small_file

MAX_LISTS = 4096
SAMPLE_PER_LIST = 64
#: Rows of a packed block of a list.
BLOCK_ROWS = 4096
#: Sampled rows whose exact neighbours set the number of probes, and the share of them to be found.
PROBE_ROWS, RECALL = 200, 0.95
ITERATIONS = 10
#: Similarities of rows and centres held at a time.
_SIMS = 1 << 19
#: Bytes of vectors that a task holds to pack them; rows of lists and queries that meet in one task at a time, and
#: bytes of either.
PACK_BYTES, CELL_ROWS, CELL_QUERIES, CELL_BYTES = 64 << 20, 1 << 17, 1 << 17, 32 << 20
_BLOCK = pa.schema([("list", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])
_BLOCK_DDL = "list int, ids binary, vecs binary"
_ASKED = pa.schema([(c, pa.int32()) for c in ("piece", "part", "cells")]
                   + [(c, pa.binary()) for c in ("ids", "vecs", "homes", "asks")])
_ASKED_DDL = "piece int, part int, cells int, ids binary, vecs binary, homes binary, asks binary"


def _sampled(rows: DataFrame, n: int, want: int) -> DataFrame:
    """About ``want`` of n rows, chosen by a hash of the id."""
    return rows if n <= want else rows.filter(F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(1 << 40)) < (want << 40) // n)


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres of greatest inner product, nearest first (x and centres are unit rows)."""
    step = max(1, _SIMS // max(1, len(centres)))
    if len(x) > step:
        return np.concatenate([nearest_lists(x[lo:lo + step], centres, n) for lo in range(0, len(x), step)])
    sims = x @ centres.T
    if n >= sims.shape[1]:
        return np.argsort(-sims, axis=1, kind="stable")
    part = np.argpartition(-sims, n, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def fit_centres(rows: DataFrame, lists: int, width: int, seed: int = 42) -> np.ndarray:
    """Spherical k-means of ``(_id, _v)``: starts from sampled rows, sums travel, rows stay where they are."""
    start = rows.orderBy(F.xxhash64(F.lit(seed), "_id")).limit(lists).toArrow()
    centres = unit_rows(vector_matrix(start["_v"], width))

    def sums(at: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(at.shape), np.zeros(len(at), np.int64)
            for batch in batches:
                x = unit_rows(vector_matrix(batch.column("_v"), width))
                own = nearest_lists(x, at, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(at))
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit, pa.int32()), pa.array(list(total[hit]), pa.list_(pa.float64()))], ["list", "total"])
        return run

    for _ in range(ITERATIONS):
        parts = rows.select("_v").mapInArrow(sums(centres), "list int, total array<double>")
        by_component = parts.select("list", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(
            F.sum("x").alias("x"))
        new = centres.copy()
        for r in by_component.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
            new[r.list] = [x.x for x in r.v]
        new = unit_rows(new)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-3:
            break
    return centres


def near_order(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which neighbours are mostly near each other: halves along the widest axis, again and again."""
    out, left = [], [np.arange(len(centres))]
    while left:
        at = left.pop()
        if len(at) < 3:
            out += at.tolist()
            continue
        at = at[np.argsort(centres[at, centres[at].var(axis=0).argmax()], kind="stable")]
        left += [at[len(at) // 2:], at[:len(at) // 2]]
    return np.array(out)


def spread(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists in their order gathered to groups of at most ``most`` rows: the group of each list, the cells of each group.

    A longer list is a group by itself and has as many cells as it takes.
    """
    group, cells, held = np.zeros(len(sizes), np.int64), [1], 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > most and held:
            cells.append(1)
            held = 0
        held += n
        group[i], cells[-1] = len(cells) - 1, max(1, -(-held // most))
    return group, np.array(cells)


def build_index(vectors: DataFrame, path: str, lists: int | None = None, *, row_id: str = "id",
                vector: str = "embedding", k: int = 10, recall: float = RECALL, seed: int = 42) -> dict:
    """Write the index of all rows with an id and a vector under ``path``; returns what is stored beside it.

    ``lists`` defaults to the square root of the rows, ``MAX_LISTS`` at most. An empty table gives an empty index.
    """
    spark, rows = vectors.sparkSession, vector_rows(vectors, row_id, vector)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    width = max(1, int(width or 0))
    lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, n))
    centres = fit_centres(_sampled(rows, n, SAMPLE_PER_LIST * lists), lists, width, seed) if n else np.zeros((1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        rows_held = 0
        for batch in batches:
            if not len(batch):
                continue
            x, ids = vector_matrix(batch.column("_v"), width), batch.column("_id").to_numpy()
            own = nearest_lists(unit_rows(x), centres, 1)[:, 0]
            for name in np.unique(own).tolist():
                part = own == name
                held.setdefault(name, []).append((ids[part], x[part].astype(np.float32)))
                rows_held += int(part.sum())
                if (n_rows := sum(len(i) for i, _ in held[name])) >= BLOCK_ROWS:
                    rows_held -= n_rows
                    yield block(name, held.pop(name))
            if rows_held * (4 * width + 8) >= PACK_BYTES:
                for name in list(held):
                    yield block(name, held.pop(name))
                rows_held = 0
        for name, parts in held.items():
            yield block(name, parts)

    def block(name: int, parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"list": name, "ids": np.concatenate([i for i, _ in parts]).tobytes(),
                                            "vecs": np.concatenate([v for _, v in parts]).tobytes()}], _BLOCK)

    (rows.mapInArrow(pack, _BLOCK_DDL).repartition("list").write.partitionBy("list").parquet(f"{path}/lists"))
    note = {"rows": n, "width": width, "lists": len(centres), "k": k, "recall": recall, "probes": len(centres),
            "centres": [[float(v) for v in c] for c in centres]}
    if n > 1:
        note["probes"] = _measured_probes(rows, n, centres, width, k, recall)
    write_small_file(spark, f"{path}/index.json", json.dumps(note))
    return note


def _measured_probes(rows: DataFrame, n: int, centres: np.ndarray, width: int, k: int, recall: float) -> int:
    """Least number of nearest lists that holds ``recall`` of the true neighbours of sampled rows."""
    asked = _sampled(rows.withColumn("_id", F.col("_id")), n, PROBE_ROWS)
    true = knn_join(asked, rows, k, query_id="_id", corpus_id="_id", vector="_v").select("qid", "id")
    # k rows at most for each sampled id, so the table itself is not shuffled
    pairs = (F.broadcast(true).join(rows.select(F.col("_id").alias("id"), F.col("_v").alias("c")), "id")
             .join(asked.select(F.col("_id").alias("qid"), F.col("_v").alias("q")), "qid").select("q", "c"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                q, c = (unit_rows(vector_matrix(b.column(x), width)) for x in ("q", "c"))
                own, step = nearest_lists(c, centres, 1), max(1, _SIMS // len(centres))
                for lo in range(0, len(q), step):
                    sims, at = q[lo:lo + step] @ centres.T, own[lo:lo + step]
                    least = np.take_along_axis(sims, at, 1)
                    before = (sims > least) | ((sims == least) & (np.arange(len(centres)) < at))
                    yield pa.RecordBatch.from_arrays([pa.array(before.sum(1).astype(np.int32))], ["place"])

    counts = sorted((r.place, r.n) for r in pairs.mapInArrow(place, "place int").groupBy("place")
                    .agg(F.count(F.lit(1)).alias("n")).collect())
    found, total = 0, sum(c for _, c in counts)
    for where, c in counts:
        found += c
        if found >= recall * total:
            return where + 1
    return len(centres)


def read_index_note(spark: SparkSession, path: str) -> dict:
    """What ``build_index`` stored beside the lists."""
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/index.json").collect()))


def search_index(queries: DataFrame, path: str, k: int = 10, *, probes: int | None = None, query_id: str = "id",
                 vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """``(qid, rank, id, sim)`` as ``knn_join`` gives it, from the lists that each query probes.

    ``probes`` defaults to the number measured for the index (for its own k; a greater k may find a smaller share).
    """
    spark = queries.sparkSession
    note = read_index_note(spark, path)
    centres, width = np.array(note["centres"]), note["width"]
    lists, probes = len(centres), max(1, min(probes or note["probes"], len(centres)))
    q = vector_rows(queries, query_id, vector)
    blocks = spark.read.schema("ids binary, vecs binary, list int").parquet(f"{path}/lists")

    # lists in an order in which neighbours are near each other; from here on a list goes by its place in it
    order = near_order(centres)
    place = np.argsort(order).astype(np.int32)
    sizes, homes = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in blocks.groupBy("list").agg(F.sum(F.length("ids") / 8).cast("long").alias("n")).collect():
        sizes[place[r.list]] = r.n
    wanted = 2 * parallelism(spark)
    most = max(1, min(CELL_ROWS, CELL_BYTES // (4 * width)))
    group, cells = spread(sizes, min(most, max(MIN_BLOCK_QUERIES, -(-int(sizes.sum()) // math.isqrt(wanted)))))
    first = np.cumsum(cells) - cells
    low = np.flatnonzero(np.diff(group, prepend=-1))  # the first list of every group
    high = np.append(low[1:], lists)

    def probed(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, home list, lists that are probed) of some rows at a time."""
        step = max(1, _SIMS // lists)
        for at in range(0, len(x), step):
            own = place[nearest_lists(unit_rows(x[at:at + step].astype(np.float64)), centres, probes)]
            mask = np.zeros((len(own), lists), bool)
            np.put_along_axis(mask, own, True, axis=1)
            yield at, own[:, 0], mask

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asks = np.zeros(lists, np.int64), np.zeros((lists, len(low)), bool)
        for batch in batches:
            for _, home, mask in probed(vector_matrix(batch.column("_v"), width, np.float32)):
                n += np.bincount(home, minlength=lists)
                row, own = np.nonzero(np.logical_or.reduceat(mask, low, axis=1))
                asks[home[row], own] = True
        home, own = np.nonzero(asks)
        new = np.diff(home, prepend=-1) > 0
        yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(own, pa.int32()),
                                          pa.array(np.where(new, n[home], 0))], ["home", "own", "n"])

    asks = q.mapInArrow(count, "home int, own int, n long").groupBy("home", "own").agg(F.sum("n").alias("n")).toArrow()
    home, own = asks["home"].to_numpy(), asks["own"].to_numpy()
    np.add.at(homes, home, asks["n"].to_numpy())
    n = int(homes.sum())
    pieces = max(1, min(-(-wanted // max(1, int(cells.sum()))), n // MIN_BLOCK_QUERIES))
    at_once = max(1, min(CELL_QUERIES, CELL_BYTES // (4 * width)))
    q_group, q_cells = spread(homes, min(at_once, max(1, -(-n // pieces))))
    q_first = np.cumsum(q_cells) - q_cells
    pairs = np.unique(np.stack([own, q_group[home]], axis=1), axis=0) if n else np.zeros((0, 2), np.int64)
    asking = {int(g): [int(q_first[p] + i) for p in pairs[pairs[:, 0] == g, 1] for i in range(q_cells[p])]
              for g in np.unique(pairs[:, 0])}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(0).integers(0, 1 << 64, width + 1, np.uint64, endpoint=False) | np.uint64(1)
        for batch in batches:
            if not len(batch):
                continue
            x, ids = vector_matrix(batch.column("_v"), width, np.float32), batch.column("_id").to_numpy()
            home, asks = np.empty(len(x), np.int16), np.empty((len(x), len(low)), bool)
            bits = np.empty((len(x), -(-lists // 8)), np.uint8)
            for at, near, mask in probed(x):
                some = slice(at, at + len(near))
                home[some], bits[some] = near, np.packbits(mask, axis=1)
                asks[some] = np.logical_or.reduceat(mask, low, axis=1)
            # the cell of a row depends on nothing but the row
            mixed = ids.astype(np.uint64) * weights[width]
            for i in range(width):
                mixed += np.ascontiguousarray(x[:, i]).view(np.uint32) * weights[i]
            mixed ^= mixed >> np.uint64(32)
            own = q_group[home]
            piece = q_first[own] + (mixed % q_cells[own].astype(np.uint64)).astype(np.int64)
            by = np.lexsort((home, piece))
            cut = np.flatnonzero(np.diff(piece[by], prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(by)), strict=True):
                rows = by[lo:hi]
                for g in np.flatnonzero(asks[rows].any(axis=0)).tolist():
                    some = rows[asks[rows, g]]
                    yield pa.RecordBatch.from_pylist(
                        [{"piece": int(piece[some[0]]), "part": int(first[g]), "cells": int(cells[g]),
                          "ids": ids[some].tobytes(), "vecs": x[some].tobytes(), "homes": home[some].tobytes(),
                          "asks": bits[some, low[g] // 8:-(-high[g] // 8)].tobytes()}], _ASKED)

    # a group of lists meets the queries that probe one of them; a long list is cut by a hash of its blocks
    table = spark.createDataFrame(
        [(int(order[i]), int(first[g]), int(cells[g]), asking[int(g)]) for i, g in enumerate(group) if int(g) in asking],
        "list int, part int, cells int, asking array<int>")  # a row per list
    left = q.mapInArrow(ask, _ASKED_DDL).withColumn(
        "part", F.explode(F.sequence(F.col("part"), F.col("part") + F.col("cells") - 1)))
    right = (blocks.join(F.broadcast(table), "list")
             .withColumn("part", F.col("part") + F.pmod(F.xxhash64("ids"), F.col("cells")).cast("int"))
             .select("list", "part", "ids", "vecs", F.explode("asking").alias("piece")))
    cell, shuffle = ["piece", "part"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffle, min(4 * sum(len(a) * int(cells[g]) for g, a in asking.items()), 2 * shuffle))
    left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)

    def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in column])

    def rank(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not len(qt) or not len(ct):
            return _KNN.empty_table()
        g = group[place[ct["list"][0].as_py()]]
        home = joined(qt["homes"], np.int16)
        by = np.argsort(home, kind="stable")
        bits = joined(qt["asks"], np.uint8).reshape(len(home), -1)[by]
        qids, x = joined(qt["ids"], np.int64)[by], joined(qt["vecs"], np.float32).reshape(-1, width)[by]
        ids, v = joined(ct["ids"], np.int64), joined(ct["vecs"], np.float32).reshape(-1, width)
        own = np.repeat(place[ct["list"].to_numpy()] - low[g] // 8 * 8, [len(b.as_buffer()) // 8 for b in ct["ids"]])
        i, found, sims = top_k(qids, x, ids, v, k, exclude_self, own, bits)
        return pa.table([qids[i], found, sims], schema=_KNN)

    return best_k(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(rank, _KNN_DDL), k)


def drop_index(spark: SparkSession, path: str) -> None:
    remove_folder(spark, path)
