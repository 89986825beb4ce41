"""Near-duplicate components by an n-gram Jaccard join with count-vector R-trees.

A document's set is its distinct word shingles as 64-bit hashes. Two sets link
when ``100 * intersection >= 80 * union``. The join runs over distinct sets
(documents with one set are one class), so copies never meet as pairs.

1. Cells. Two linked sets share a shingle among the first ``n - ceil(.8 n) + 1``
   of each in any common order. The order is by how often a shingle's hash
   bucket occurs in the corpus (a sketch of ``BUCKETS`` counters over all
   documents), then by hash, so passages that many documents share come last
   and cells stay small. Cells with the same members are kept once.
2. Points. A class is a point, the counts of its shingles in ``GROUPS`` hash
   groups; the sum of two points' coordinate minima bounds their intersection.
   Trees use the counts of ``FOLD`` groups together, a coarser bound, and the
   finer one where that allows a link.
3. Leaders. In each cell a class that the bound lets link with an earlier
   leader is paired with it, any other becomes a leader; every class is
   verified against the leader that most cells propose, and the links are
   joined to components. A family of many near copies costs as many pairs as
   it has members.
4. The rest. Only cells that still hold several components go on. A packed
   R-tree over a cell's points is joined with itself: pairs of boxes, then of
   points, go on only if sizes and bound allow a link. The classes that take
   part in such a pair across components are tied to families; a family's texts
   meet, the R-tree join runs over them again, and every pair across components
   is verified unless links found before it have joined the two.

A pair of linked sets therefore is in one component after 3 or after 4: no link
is lost that would join components. Verification reads the texts of the classes
concerned only, in groups of at most ``CHUNK`` partners of one leader or two
blocks of a family; cells and families of over ``BLOCK`` classes are cut into
blocks.

Defined results: a text without words, or null, has no set, links with nothing
and is its own component; fewer than five words form one shingle; repeated rows
are copies; a component is named by its least non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width
from tessera.llm.wordhash import hash_words, mix
from tessera.session import cut_lineage

SHINGLE = 5
BUCKETS = 1 << 18
GROUPS = 512
#: Groups summed into one coordinate of the tree; the finer counts are compared only where it allows a link.
FOLD = 4
CHUNK = 256
BLOCK = 1024
LEAF, FAN = 32, 16
#: Rows of a key table that may be broadcast to fetch texts (checked by a count); beyond, a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000
COUNTER_BLOCK = 4096
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes | None], order: np.ndarray | None = None,
                 size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingles of all texts one after the other, where each text starts).

    With ``order`` (a permutation of the hash buckets) a shingle's leading bits
    are replaced by its bucket's place, a bijection that makes the numeric
    order the cells' common order.
    """
    h, n, *_ = hash_words(texts)
    end = np.cumsum(n)
    count = np.where(n >= size, n - size + 1, n > 0)  # a short text is one shingle
    stop = np.cumsum(count)
    # every run of words in the joined texts, then those that lie inside one text
    run = h[:max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        run = run * _ODD + h[k:k + len(run)]
    shingles = np.zeros(int(count.sum()), np.uint64)
    long = np.flatnonzero(n >= size)
    take = count[long]
    inside = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
    shingles[np.repeat(stop[long] - take, take) + inside] = run[np.repeat(end[long] - n[long], take) + inside]
    for i in np.flatnonzero((n > 0) & (n < size)).tolist():
        value = np.uint64(n[i])
        for x in h[end[i] - n[i]:end[i]]:
            value = (np.array([value]) * _ODD + x)[0]
        shingles[stop[i] - 1] = value
    shingles = mix(shingles)
    if order is not None:
        rest = np.uint64(64 - (BUCKETS.bit_length() - 1))
        shingles = (order[_bucket(shingles)] << rest) | (shingles & ((np.uint64(1) << rest) - np.uint64(1)))
    for lo, hi in zip((stop - count).tolist(), stop.tolist(), strict=True):
        shingles[lo:hi].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    new[(stop - count)[count > 0]] = True
    starts = np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], stop])]
    return shingles[new], starts


def _reduce(f, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``f`` over each text's shingles; 0 for an empty set."""
    out = np.zeros(len(starts) - 1, values.dtype)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        out[some] = f.reduceat(values, starts[some])
    return out


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each set: one 64-bit value of all its shingles."""
    total = _reduce(np.add, shingles, starts) + _reduce(np.bitwise_xor, shingles, starts) * np.uint64(3)
    return mix(total + np.diff(starts).astype(np.uint64)).view(np.int64)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _texts(batch, column: int) -> list:
    return batch.column(column).to_pylist()


def pack_counts(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as a scale and bytes, ``scale * byte`` no smaller than the count."""
    counts = counts.astype(np.int64)
    scale = np.maximum(1, -(-counts.max(axis=1) // 255))
    rows = (-(-counts // scale[:, None])).astype(np.uint8)
    return [s.tobytes() + q.tobytes() for s, q in zip(scale.astype(np.uint32), rows, strict=True)]


def unpack_counts(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    scale = raw[:, :4].copy().view(np.uint32)
    return raw[:, 4:].astype(np.uint16 if not len(raw) or scale.max() <= 257 else np.uint32) * scale.astype(
        np.uint16 if not len(raw) or scale.max() <= 257 else np.uint32)


def fold_counts(vec: np.ndarray) -> np.ndarray:
    """Coarser counts: the minima of sums bound the sums of minima."""
    return vec.reshape(len(vec), -1, FOLD).sum(axis=2, dtype=np.uint32)


def finer(vec: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) the fine counts allow to link."""
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]
        ok[lo:lo + (1 << 14)] = 9 * np.minimum(vec[a], vec[b]).sum(1, dtype=np.int64) >= 4 * (n[a] + n[b])
    return ok


def profiles(docs: DataFrame) -> DataFrame:
    """Rows of (row, text) -> row, n, sig (the row number for an empty set), vec (packed group counts).

    A row without ``row`` holds, as ``vec``, the counters of one task: how many
    distinct (document, shingle) fall in the buckets of block ``n``.
    """
    import pyarrow as pa
    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("vec", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(), _texts(batch, 1)
            for lo in range(0, len(texts), 512):
                own = rows[lo:lo + 512]
                s, starts = shingle_sets(texts[lo:lo + 512])
                n = np.diff(starts)
                total += np.bincount(_bucket(s), minlength=BUCKETS)
                group = np.repeat(np.arange(len(own)), n) * GROUPS + (s % np.uint64(GROUPS)).astype(np.int64)
                vec = pack_counts(np.bincount(group, minlength=len(own) * GROUPS).reshape(len(own), GROUPS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(n, pa.int64()), pa.array(np.where(n > 0, signatures(s, starts), own)),
                     pa.array(vec, pa.binary())], schema=schema)
        blocks = range(0, BUCKETS, COUNTER_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(blocks), pa.int64()), pa.array([b // COUNTER_BLOCK for b in blocks], pa.int64()),
             pa.array(np.arange(len(blocks)), pa.int64()),
             pa.array([total[b:b + COUNTER_BLOCK].astype(np.uint32).tobytes() for b in blocks], pa.binary())],
            schema=schema)

    return docs.select("row", "text").mapInArrow(scan, "row long, n long, sig long, vec binary")


def bucket_order(profile: DataFrame) -> np.ndarray:
    """Each bucket's place when they are sorted by their counters; BUCKETS numbers reach the driver."""
    import pyarrow as pa

    def add(group: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("vec").to_pylist())
        return pa.table({"n": group.column("n").slice(0, 1), "vec": pa.array([n.tobytes()], pa.binary())})

    parts = profile.filter("row is null").select("n", "vec").groupBy("n").applyInArrow(add, "n long, vec binary")
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():
        total[r["n"] * COUNTER_BLOCK:(r["n"] + 1) * COUNTER_BLOCK] = np.frombuffer(bytes(r["vec"]), np.int64)
    place = np.empty(BUCKETS, np.uint64)
    place[np.argsort(total, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return place


def cells(docs: DataFrame, order: np.ndarray, shards: int) -> DataFrame:
    """Distinct member lists of the prefix cells with two classes or more: cell, hub, weight, members."""
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        schema = pa.schema([("shard", pa.int32()), ("h", pa.binary()), ("sig", pa.binary())])
        for batch in batches:
            seen: set[int] = set()
            keep_h, keep_sig = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            texts = _texts(batch, 0)
            for lo in range(0, len(texts), 512):
                s, starts = shingle_sets(texts[lo:lo + 512], place)
                n = np.diff(starts)
                # the signature is that of the plain shingles: undo the order's bijection
                sig = signatures(_plain(s, place), starts)
                wanted = []
                for i, x in enumerate(sig.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        wanted.append(i)
                p = n[wanted] - (4 * n[wanted] + 4) // 5 + 1
                at = np.repeat(starts[wanted] - (np.cumsum(p) - p), p) + np.arange(p.sum())
                keep_h.append(s[at])
                keep_sig.append(np.repeat(sig[wanted], p))
            h, sig = np.concatenate(keep_h), np.concatenate(keep_sig)
            if not len(h):
                continue
            shard = (mix(h) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            h, sig, shard = h[by], sig[by], shard[by]
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            yield pa.RecordBatch.from_pylist(
                [{"shard": int(shard[a]), "h": h[a:b].tobytes(), "sig": sig[a:b].tobytes()}
                 for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True)], schema)

    def gather(group: pa.Table) -> pa.Table:
        import xxhash
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("h").to_pylist()])
        sig = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("sig").to_pylist()])
        by = np.lexsort((sig, h))
        h, sig = h[by], sig[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig = h[new], sig[new]
        cut = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        size = np.diff(np.append(cut, len(h)))
        lists: dict[bytes, int] = {}
        for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            key = sig[a:a + n].tobytes()
            lists[key] = lists.get(key, 0) + 1
        names = [xxhash.xxh3_64_intdigest(k) >> 1 for k in lists]
        return pa.table({"cell": pa.array(names, pa.int64()),
                         "members": pa.array(list(lists), pa.binary()),
                         "weight": pa.array(list(lists.values()), pa.int64())})

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(cell), 1024):
                lists = [np.frombuffer(m, np.int64) for m in batch.column(2).slice(lo, 1024).to_pylist()]
                k = np.array([len(m) for m in lists])
                own = slice(lo, lo + 1024)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cell[own], k)), pa.array(np.repeat(weight[own], k)),
                     pa.array(np.repeat([m[0] for m in lists], k)), pa.array(np.concatenate(lists)),
                     pa.array(np.repeat(k, k))], ["cell", "weight", "hub", "sig", "size"])

    lists = (docs.select("text").mapInArrow(prefixes, "shard int, h binary, sig binary")
             .groupBy("shard").applyInArrow(gather, "cell long, members binary, weight long")
             .groupBy("cell").agg(F.sum("weight").alias("weight"), F.first("members").alias("members")))
    return lists.select("cell", "weight", "members").mapInArrow(
        explode, "cell long, weight long, hub long, sig long, size long")


def _plain(ordered: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles whose leading bits ``place`` has replaced."""
    rest = np.uint64(64 - (BUCKETS.bit_length() - 1))
    back = np.empty(BUCKETS, np.uint64)
    back[place.astype(np.int64)] = np.arange(BUCKETS, dtype=np.uint64)
    return (back[_bucket(ordered)] << rest) | (ordered & ((np.uint64(1) << rest) - np.uint64(1)))


def class_texts(sigs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """sig, text: one text of each class that ``sigs`` names."""
    need = cut_lineage(sigs.distinct().join(classes.select("sig", "row"), "sig"))
    small = need.count() <= MAX_BROADCAST_ROWS
    return docs.select("row", "text").join(F.broadcast(need) if small else need, "row").select("sig", "text")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, from the texts of one row of each class."""
    import pyarrow as pa
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    pairs = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    keys = pairs.select("a", "chunk", F.col("b").alias("sig")).unionByName(
        pairs.select("a", "chunk", F.col("a").alias("sig")).distinct())
    texts = class_texts(keys.select("sig"), classes, docs)

    def check(group: pa.Table) -> pa.Table:
        a, sig = group.column("a")[0].as_py(), group.column("sig").to_pylist()
        s, starts = shingle_sets(group.column("text").to_pylist())
        n = np.diff(starts)
        i = sig.index(a)
        hub = s[starts[i]:starts[i + 1]]
        at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
        both = _reduce(np.add, (hub[at] == s).astype(np.int64), starts)
        # 100 both >= 80 (|A| + |B| - both)
        out = [x for x, ok in zip(sig, (9 * both >= 4 * (n + n[i])).tolist(), strict=True) if ok and x != a]
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return keys.join(texts, "sig").groupBy("a", "chunk").applyInArrow(check, "a long, b long")


def rtree(vec: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Packed tree: an order of the points, and by level the boxes (greatest vector, least and greatest size, cut).

    Points are sorted by size and, within runs of equal length, by their widest
    coordinate; leaves take ``LEAF`` neighbours, every upper node ``FAN`` nodes.
    """
    order = np.argsort(n, kind="stable")
    run = max(LEAF, int(np.sqrt(len(n) / LEAF)) * LEAF)
    for lo in range(0, len(order), run):
        part = order[lo:lo + run]
        order[lo:lo + run] = part[np.argsort(vec[part][:, np.ptp(vec[part], axis=0).argmax()], kind="stable")]
    levels, top, low, high = [], vec[order], n[order], n[order]
    width = LEAF
    while True:
        cut = np.arange(0, len(top), width)
        top = np.maximum.reduceat(top, cut, axis=0)
        low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
        levels.append((top, low, high, cut))
        if len(cut) <= FAN:
            return order, levels
        width = FAN


def rtree_join(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]):
    """Pairs of points (i, j) whose sizes and summed coordinate minima allow a link."""
    (va, na), (vb, nb) = left, right
    if not len(na) or not len(nb):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (oa, la), (ob, lb) = rtree(va, na), rtree(vb, nb)

    def passes(ta, lo_a, hi_a, tb, lo_b, hi_b):
        ok = (5 * hi_a >= 4 * lo_b) & (5 * hi_b >= 4 * lo_a)
        ok[ok] = 9 * np.minimum(ta[ok], tb[ok]).sum(1, dtype=np.int64) >= 4 * (lo_a[ok] + lo_b[ok])
        return ok

    def children(level, node, size):
        cut = np.append(level[3], size)
        return cut[node], cut[node + 1] - cut[node]

    depth_a, depth_b = len(la) - 1, len(lb) - 1
    i = np.repeat(np.arange(len(la[depth_a][1])), len(lb[depth_b][1]))
    j = np.tile(np.arange(len(lb[depth_b][1])), len(la[depth_a][1]))
    pa_, pb_ = (va[oa], na[oa], na[oa]), (vb[ob], nb[ob], nb[ob])
    while True:
        a = la[depth_a][:3] if depth_a >= 0 else pa_
        b = lb[depth_b][:3] if depth_b >= 0 else pb_
        keep = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
            keep[lo:lo + (1 << 16)] = passes(a[0][x], a[1][x], a[2][x], b[0][y], b[1][y], b[2][y])
        i, j = i[keep], j[keep]
        if depth_a < 0 and depth_b < 0:
            return oa[i], ob[j]
        # open the deeper side, or both when level
        if depth_a >= depth_b:
            at, n = children(la[depth_a], i, len(la[depth_a - 1][1]) if depth_a else len(na))
            i = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            j = np.repeat(j, n)
            depth_a -= 1
        else:
            at, n = children(lb[depth_b], j, len(lb[depth_b - 1][1]) if depth_b else len(nb))
            j = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i = np.repeat(i, n)
            depth_b -= 1


def leader_pairs(vec: np.ndarray, n: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """A pair (leader, point) for each point that the bound lets link with an earlier leader.

    A point that no leader may link with becomes a leader itself; of several
    leaders in other components the one of the highest bound is taken.
    """
    lead = np.zeros(len(n), np.int64)
    k, out, rough = 0, [], fold_counts(vec)
    for i in range(len(n)):
        at = lead[:k]
        at = at[(5 * n[at] >= 4 * n[i]) & (5 * n[i] >= 4 * n[at])]
        at = at[9 * np.minimum(rough[at], rough[i]).sum(1, dtype=np.int64) >= 4 * (n[at] + n[i])]
        both = np.minimum(vec[at], vec[i]).sum(1, dtype=np.int64)
        share = both / (n[at] + n[i])
        ok = 9 * both >= 4 * (n[at] + n[i])
        if not ok.any():
            lead[k] = i
            k += 1
            continue
        ok &= comp[at] != comp[i]
        if ok.any():
            out.append((int(at[np.where(ok, share, -1.0).argmax()]), i))
    return out


def _units(mixed: DataFrame, block: int, pairwise: bool) -> DataFrame:
    """Rows of cells dealt out as units of work: a block of a cell, or each pair of its blocks.

    A cell is cut into blocks of about ``block`` classes; the units go over the
    shuffle's partitions, many small ones to a ``shard``.
    """
    shards = 4 * shuffle_width(mixed.sparkSession)
    n = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("sig"), n).cast("int")
    others = F.sequence(F.lit(0), n - 1) if pairwise else F.array(own)
    return (mixed.withColumn("block", own).withColumn("other", F.explode(others))
            .select("cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                    "block", "weight", "sig", "comp", "n", "vec")
            .withColumn("shard", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(shards))))


def _each_unit(group) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, vectors, rows of the unit by block and class) of every unit of a shard."""
    c = {k: group.column(k).to_numpy() for k in ("cell", "x", "y", "block", "weight", "sig", "comp", "n")}
    vec = unpack_counts(group.column("vec").to_pylist())
    order = np.lexsort((c["sig"], c["block"], c["y"], c["x"], c["cell"]))
    key = np.stack([c["cell"], c["x"], c["y"]], 1)[order]
    cut = np.append(np.flatnonzero((np.diff(key, axis=0, prepend=key[:1] - 1) != 0).any(1)), len(order))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield c, vec, order[lo:hi]


def leaders(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every class the leader that most cells propose: a (leader), b.

    Rows of (cell, size, weight, sig, comp, n, vec).
    """
    import pyarrow as pa

    def lead(group: pa.Table) -> pa.Table:
        found, weights = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for c, vec, unit in _each_unit(group):
            got = np.array(leader_pairs(vec[unit], c["n"][unit], c["comp"][unit]), np.int64).reshape(-1, 2)
            found.append(c["sig"][unit][got])
            weights.append(np.full(len(got), c["weight"][unit[0]], np.int64))
        pairs, place = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        w = np.bincount(place.reshape(-1), np.concatenate(weights), len(pairs)).astype(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()),
                         "w": pa.array(w, pa.int64())})

    near = _units(points, block, False).groupBy("shard").applyInArrow(lead, "a long, b long, w long")
    return (near.groupBy("a", "b").agg(F.sum("w").alias("w")).groupBy("b")
            .agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b"))


def open_edges(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The classes that the bound lets link with one of another component in a cell: a (the least of them), b.

    Rows as for ``leaders``. A unit's pairs are found by the R-tree join and
    reduced to the classes that take part in one, each tied to the least: as
    many rows as classes, not pairs.
    """
    import pyarrow as pa

    def reduce(group: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), np.int64)]
        for c, vec, unit in _each_unit(group):
            p, q = (unit[c["block"][unit] == c[k][unit[0]]] for k in ("x", "y"))
            i, j = rtree_join((fold_counts(vec[p]), c["n"][p]), (fold_counts(vec[q]), c["n"][q]))
            i, j = p[i], q[j]
            keep = c["comp"][i] != c["comp"][j]
            i, j = i[keep], j[keep]
            keep = finer(vec, c["n"], i, j)
            sig = np.unique(c["sig"][np.concatenate([i[keep], j[keep]])])
            found.append(np.stack([np.full(len(sig), sig[0] if len(sig) else 0), sig], 1))
        edges = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return _units(mixed, block, True).groupBy("shard").applyInArrow(reduce, "a long, b long").distinct()


def verify_families(members: DataFrame, classes: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The links (a, b) that join components within each family, from whole texts.

    Rows of (family, sig, comp). A family of over ``block`` classes is cut into
    blocks that meet in pairs. All pairs of different components that sizes and
    bound allow are verified, but for those that links found before in the same
    group have joined already.
    """
    import pyarrow as pa
    texts = class_texts(members.select("sig"), classes, docs)
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    dealt = (members.join(blocks, "family").withColumn("block", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                     "block", "sig", "comp"))

    def check(group: pa.Table) -> pa.Table:
        sig, comp, own_, x, y = (group.column(c).to_numpy() for c in ("sig", "comp", "block", "x", "y"))
        s, starts = shingle_sets(group.column("text").to_pylist())
        n = np.diff(starts)
        at = np.repeat(np.arange(len(n)), n) * GROUPS + (s % np.uint64(GROUPS)).astype(np.int64)
        vec = np.bincount(at, minlength=len(n) * GROUPS).astype(np.uint32).reshape(len(n), GROUPS)
        p, q = np.flatnonzero(own_ == x), np.flatnonzero(own_ == y)
        i, j = rtree_join((fold_counts(vec[p]), n[p]), (fold_counts(vec[q]), n[q]))
        i, j = p[i], q[j]
        keep = (comp[i] != comp[j]) & ((i < j) | (x[0] != y[0]))
        i, j = i[keep], j[keep]
        keep = finer(vec, n, i, j)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        out = []
        for k, m in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            a, b = find(int(comp[k])), find(int(comp[m]))
            if a != b:
                both = len(np.intersect1d(s[starts[k]:starts[k + 1]], s[starts[m]:starts[m + 1]], assume_unique=True))
                if 9 * both >= 4 * (n[k] + n[m]):
                    root[max(a, b)] = min(a, b)
                    out.append((int(sig[k]), int(sig[m])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()),
                         "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.join(texts, "sig").groupBy("family", "x", "y").applyInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Rows of (a, b) -> node, comp (the least node it is connected with), by large and small stars."""
    def cut(d: DataFrame) -> tuple[DataFrame, dict]:
        """The edges written, with their number and a sum over them, observed as they are written."""
        seen = Observation()
        out = cut_lineage(d.observe(seen, F.count("*").alias("n"),
                                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        return out, seen.get

    e, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct())
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        e, after = cut(small)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) -> row, doc_id, n_shingles, component, class_id, component_id.

    ``component`` numbers the components (null without a set), ``row`` is the row number of the scan (``docs`` should be a table read as it
    lies), ``class_id`` the least doc_id with the same set.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    scanned = cut_lineage(profiles(rows))
    profile = rows.select("row", "doc_id").join(scanned, "row")
    classes = cut_lineage(profile.filter("n > 0").groupBy("sig").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("class_id"), F.min("n").alias("n"), F.min("vec").alias("vec")))
    cell = cut_lineage(cells(rows, bucket_order(scanned), 2 * shuffle_width(spark)))
    own = F.coalesce("comp", F.col("sig")).alias("comp")
    point = classes.select("sig", "n", "vec")
    linked = cut_lineage(verify(cut_lineage(leaders(
        cell.withColumn("comp", F.col("sig")).join(point, "sig"))), classes, rows))
    first = components(linked)
    named = cell.join(first.withColumnRenamed("node", "sig"), "sig", "left").select(
        "cell", "size", "weight", "sig", own)
    several = (named.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
               .filter("x <> y").select("cell"))
    mixed = named.join(several, "cell").join(point, "sig")
    edges = cut_lineage(open_edges(mixed))
    family = F.coalesce(F.col("comp"), F.col("sig")).alias("family")
    grouped = (edges.select(F.col("b").alias("sig")).distinct()
               .join(components(edges).withColumnRenamed("node", "sig"), "sig", "left").select("sig", family))
    members = cut_lineage(grouped.join(first.withColumnRenamed("node", "sig"), "sig", "left").select(
        "family", "sig", own))
    more = cut_lineage(verify_families(members, classes, rows))
    final = components(first.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    of = classes.select("sig", "class_id").join(final.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "class_id", own)
    ids = of.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    result = of.join(ids, "comp").select("sig", "class_id", "component_id", F.col("comp").alias("component"))
    found = F.col("_one") & (F.col("n") > 0)
    return (profile.select("row", "doc_id", "n", "sig").join(result.withColumn("_one", F.lit(True)), "sig", "left")
            .select("row", "doc_id", F.col("n").alias("n_shingles"), "component",
                    F.when(found, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(found, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
