"""Exact top-k of vector blocks inside a task: NumPy work shared by the exact and the indexed search.

A tile of similarities is one float32 product. It only picks candidates, with a
margin for its rounding; a candidate's score is then recomputed from two integer
limbs per component, whose sums are exact in float64. A score therefore does not
depend on the tile it was met in, and ties are broken by id exactly. Only tiles
and a bounded number of pairs are ever held in float64, whatever the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Corpus rows and queries of one tile.
TILE_ROWS, TILE_QUERIES = 4096, 512
#: Pairs scored exactly at a time.
PAIRS = 8192


def vector_matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column without null lists as a matrix; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; a zero row stays zero (similarity 0 to all)."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norms > 0, m / np.where(norms > 0, norms, 1.0), 0.0)


def limbs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each component as two integers, ``x ~ hi / s + lo / s**2``.

    ``s`` is such that sums of ``dims`` products of either stay below 2**53, so
    they are exact whatever the order of summation.
    """
    s = float(2 ** ((52 - int(np.ceil(np.log2(max(2, m.shape[1]))))) // 2))
    hi = np.round(m * s)
    return hi, np.round((m * s - hi) * s), s


def pair_scores(q, c, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine similarities of the pairs (i, j) of two limb matrices."""
    (qh, ql, s), (ch, cl, _) = q, c
    high = np.einsum("ij,ij->i", qh[i], ch[j])
    return high / (s * s) + (np.einsum("ij,ij->i", qh[i], cl[j]) + np.einsum("ij,ij->i", ql[i], ch[j])) / (s * s * s)


def margin(dims: int) -> np.float32:
    """Twice what a float32 product of two unit vectors can be off: rounding of both, of the products and of their sum."""
    return np.float32((dims + 8) * 2.0 ** -23)


def candidates(sims: np.ndarray, k: int, floor: np.ndarray, off: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs of a tile that may be among a query's k best and reach its ``floor``."""
    n, low = sims.shape[1], floor.astype(np.float32)
    hit = sims >= (low - off)[:, None]
    if n > k:
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
        if len(many):
            part = sims[many]
            low = np.maximum(low[many], np.partition(part, n - k, axis=1)[:, n - k])
            hit[many] = part >= (low - off)[:, None]
    i, j = np.divmod(np.flatnonzero(hit), n)
    some = sims[i, j] > -np.inf
    return i[some], j[some]


def top_k(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool,
          lists: np.ndarray | None = None, asked: np.ndarray | None = None):
    """(query number, id, similarity) of the k best rows of every query: best first, ties by the smaller id.

    With ``lists``, the list of every row, a query reads only the lists whose bit is set in its row of ``asked``
    (as ``np.packbits`` makes it).
    """
    rows_q, rows_id, rows_s = [], [], []
    lists = np.zeros(len(cids), np.int32) if lists is None else lists
    ordered = np.lexsort((cids, lists))
    cids, lists, off = cids[ordered], lists[ordered], margin(c.shape[1])

    def unit(m: np.ndarray) -> np.ndarray:
        return unit_rows(m.astype(np.float64))

    near = np.empty(c.shape, np.float32)
    for lo in range(0, len(cids), TILE_ROWS):
        near[lo:lo + TILE_ROWS] = unit(c[ordered[lo:lo + TILE_ROWS]])
    lost = np.flatnonzero(~np.isfinite(near).all(axis=1))
    cut = np.append(np.flatnonzero(np.diff(lists, prepend=-1)), len(lists))
    tiles = [(int(lists[a]), lo, min(lo + TILE_ROWS, b)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
             for lo in range(a, b, TILE_ROWS)]
    for at in range(0, len(qids), TILE_QUERIES):
        ids, part = qids[at:at + TILE_QUERIES], unit(q[at:at + TILE_QUERIES])
        exact, part = limbs(part), part.astype(np.float32)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = np.full(len(ids), -np.inf)
        reads = None if asked is None else np.unpackbits(asked[at:at + TILE_QUERIES], axis=1).astype(bool)
        held, pairs, seen = [], 0, 0
        for number, (name, lo, hi) in enumerate(tiles):
            some = np.arange(len(ids)) if reads is None else np.flatnonzero(reads[:, name])
            if len(some):
                own = cids[lo:hi]
                sims = (part if len(some) == len(ids) else part[some]) @ near[lo:hi].T
                sims[:, lost[(lost >= lo) & (lost < hi)] - lo] = -np.inf
                if exclude_self:
                    first, last = np.searchsorted(own, ids[some], "left"), np.searchsorted(own, ids[some], "right")
                    for r in np.flatnonzero(first < last).tolist():
                        sims[r, first[r]:last[r]] = -np.inf
                i, j = candidates(sims, k, floor[some], off)
                if len(i):
                    held.append((some[i], lo + j))
                pairs, seen = pairs + len(i), seen + hi - lo
            # short lists are scored and ranked together
            if not held or (seen < TILE_ROWS and pairs < 8 * k * len(ids) and number < len(tiles) - 1):
                continue
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            held, pairs, seen = [], 0, 0
            s = np.empty(len(i))
            for a in range(0, len(i), PAIRS):
                rows, place = np.unique(j[a:a + PAIRS], return_inverse=True)
                s[a:a + PAIRS] = pair_scores(exact, limbs(unit(c[ordered[rows]])), i[a:a + PAIRS], place)
            i, d, s = (np.concatenate(x) for x in zip(best, (i, cids[j], s), strict=True))
            order = np.lexsort((d, -s, i))
            i, d, s = i[order], d[order], s[order]
            start = np.searchsorted(i, np.arange(len(ids) + 1))
            place = np.arange(len(i)) - start[i]
            best = tuple(x[place < k] for x in (i, d, s))
            full = np.diff(start) >= k
            floor[full] = s[start[:-1][full] + k - 1]
        rows_q.append(best[0] + at)
        rows_id.append(best[1])
        rows_s.append(best[2])
    if not rows_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in (rows_q, rows_id, rows_s))
