"""Clustering and its diagnostics: k-means, k sweep, silhouette, centroids,
representatives, names.

Silhouette is exact: every pair distance is computed once on the block grid,
but each cell only emits per-(point, cluster) distance sums, so the shuffle is
``points x clusters`` rows, never ``points^2``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as VF
from tessera.operators.blocks import DEFAULT_LEFT_ROWS, DEFAULT_RIGHT_ROWS, grid_cells, plan_grid

_SUMS_SCHEMA = "id long, j int, own long, other long, dist_sum double, n long"
#: Left rows and right rows of one tile of distances.
_CHUNK, _RIGHT_CHUNK = 512, 2048


def _cell_cluster_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distance sums per (point, labelling j, other cluster) for one grid cell.

    ``_l`` holds one label per labelling; the distance block is computed once
    and reused for every labelling (e.g. every k of a sweep).
    """
    left = pdf[pdf["_side"] == 0]
    right = pdf[pdf["_side"] == 1]
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "j": pd.Series([], dtype="int32"),
                             "own": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"),
                             "dist_sum": pd.Series([], dtype="float64"), "n": pd.Series([], dtype="int64")})
    rmat = np.vstack([np.asarray(v, dtype=np.float64) for v in right["_v"].values])
    rsq = np.einsum("ij,ij->i", rmat, rmat)
    rlabs = np.vstack([np.asarray(v, dtype=np.int64) for v in right["_l"].values])
    lids = left["_id"].to_numpy(dtype=np.int64)
    llabs = np.vstack([np.asarray(v, dtype=np.int64) for v in left["_l"].values])
    lmat = np.vstack([np.asarray(v, dtype=np.float64) for v in left["_v"].values])
    onehots = []
    for j in range(rlabs.shape[1]):
        labels, inv = np.unique(rlabs[:, j], return_inverse=True)
        onehot = np.zeros((len(rlabs), len(labels)))
        onehot[np.arange(len(rlabs)), inv] = 1.0
        onehots.append((labels, onehot, onehot.sum(axis=0).astype(np.int64)))
    parts = []
    for s in range(0, len(lids), _CHUNK):
        q = lmat[s:s + _CHUNK]
        nq, qsq = len(q), np.einsum("ij,ij->i", q, q)[:, None]
        totals = [np.zeros((nq, len(labels))) for labels, _, _ in onehots]
        for t in range(0, len(rmat), _RIGHT_CHUNK):
            dist = q @ rmat[t:t + _RIGHT_CHUNK].T
            dist *= -2.0
            dist += qsq + rsq[None, t:t + _RIGHT_CHUNK]
            np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
            for total, (_, onehot, _) in zip(totals, onehots, strict=True):
                total += dist @ onehot[t:t + _RIGHT_CHUNK]
        for j, (sums, (labels, _, counts)) in enumerate(zip(totals, onehots, strict=True)):
            parts.append(pd.DataFrame({
                "id": np.repeat(lids[s:s + _CHUNK], len(labels)),
                "j": np.full(nq * len(labels), j, dtype=np.int32),
                "own": np.repeat(llabs[s:s + _CHUNK, j], len(labels)),
                "other": np.tile(labels, nq),
                "dist_sum": sums.reshape(-1),
                "n": np.tile(counts, nq),
            }))
    return pd.concat(parts, ignore_index=True)


def _silhouette_rows(p: DataFrame, left_rows: int, right_rows: int) -> DataFrame:
    """Per (point, labelling): a, b, s from one pass of pair distances.

    ``p`` is ``(_id, _v ARRAY<FLOAT>, _l ARRAY<LONG>)``, one label per labelling.
    """
    spark = p.sparkSession
    st = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    n, dims = int(st["n"]), int(st["d"] or 0)
    grid = plan_grid(spark, n, n, left_rows, right_rows, dims=dims)
    sums = grid_cells(p, p, grid).groupBy("_cell").applyInPandas(_cell_cluster_sums, _SUMS_SCHEMA)
    per = (sums.groupBy("id", "j", "own", "other").agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n").alias("n"))
           .withColumn("n", F.when(F.col("own") == F.col("other"), F.col("n") - 1).otherwise(F.col("n"))))
    ab = per.groupBy("id", "j", "own").agg(
        F.max(F.when(F.col("own") == F.col("other"), F.col("dist_sum") / F.nullif(F.col("n"), F.lit(0)))).alias("a"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("dist_sum") / F.col("n"))).alias("b"),
        F.max(F.when(F.col("own") == F.col("other"), F.col("n"))).alias("_others"))
    s = (F.when(F.col("b").isNull(), F.lit(None).cast("double"))
         .when(F.col("_others") == 0, F.lit(0.0))
         .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return ab.select("id", "j", "own", "a", "b", s.alias("s"))


def silhouette_samples(points: DataFrame, label: str = "label", vector: str = "embedding",
                       id_col: str = "id", left_rows: int = DEFAULT_LEFT_ROWS,
                       right_rows: int = DEFAULT_RIGHT_ROWS) -> DataFrame:
    """Per-point exact Euclidean silhouette ``(id, label, a, b, s)`` (A5).

    a = mean distance to the other members of its own cluster, b = smallest
    mean distance to another cluster, s = (b - a) / max(a, b); s = 0 for a
    singleton cluster; s is null when there is only one cluster.
    """
    p = points.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v"),
                      F.col(label).cast("long").alias("_l")).dropna()
    rows = _silhouette_rows(p.withColumn("_l", F.array("_l")), left_rows, right_rows)
    return rows.select("id", F.col("own").cast(points.schema[label].dataType).alias(label), "a", "b", "s")


def silhouette(points: DataFrame, label: str = "label", vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """Mean silhouette over all points, one row ``(n, silhouette)`` (A5)."""
    smp = silhouette_samples(points, label, vector, id_col)
    return smp.agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def silhouettes(points: DataFrame, labellings: list[str], vector: str = "embedding", id_col: str = "id",
                left_rows: int = DEFAULT_LEFT_ROWS, right_rows: int = DEFAULT_RIGHT_ROWS) -> DataFrame:
    """Mean silhouette of several labellings of the same points, ``(labelling, n, silhouette)``.

    Pair distances are computed once on the grid and reused for every
    labelling (the k sweep scores all k from one pass).
    """
    p = points.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v"),
                      F.array(*[F.col(c).cast("long") for c in labellings]).alias("_l")).dropna()
    rows = _silhouette_rows(p, left_rows, right_rows)
    names = F.array(*[F.lit(c) for c in labellings])
    return (rows.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))
            .select(F.element_at(names, F.col("j") + 1).alias("labelling"), "n", "silhouette"))


def _batch_points(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return (np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["_v"].values]),
            np.vstack([np.asarray(v, dtype=np.int64) for v in pdf["_l"].values]))


def cluster_sums(p: DataFrame) -> dict[int, dict[int, tuple[int, float, np.ndarray]]]:
    """{labelling: {label: (n, sum of squared norms, sum vector)}} of ``(_v, _l)`` rows, in one pass.

    Labellings x clusters x dimensions numbers reach the driver, as many as
    the centroids.
    """
    def run(it):
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in it:
            if pdf.empty:
                continue
            v, labels = _batch_points(pdf)
            rows = np.concatenate([np.ones((len(v), 1)), np.einsum("ij,ij->i", v, v)[:, None], v], axis=1)
            for j in range(labels.shape[1]):
                for c in np.unique(labels[:, j]):
                    part = rows[labels[:, j] == c].sum(axis=0)
                    total[j, int(c)] = total.get((j, int(c)), 0) + part
        for (j, c), x in total.items():
            yield pd.DataFrame({"j": j, "c": c, "i": np.arange(len(x)), "x": x})

    rows = (p.select("_v", "_l").mapInPandas(run, "j int, c long, i int, x double")
            .groupBy("j", "c", "i").agg(F.sum("x").alias("x")).collect())
    flat: dict[tuple[int, int], dict[int, float]] = {}
    for r in rows:
        flat.setdefault((r["j"], r["c"]), {})[r["i"]] = r["x"]
    out: dict[int, dict[int, tuple[int, float, np.ndarray]]] = {}
    for (j, c), x in flat.items():
        v = np.array([x[i] for i in range(len(x))])
        out.setdefault(j, {})[c] = (int(round(v[0])), v[1], v[2:])
    return out


def silhouettes_linear(points: DataFrame, labellings: list[str], vector: str = "embedding") -> DataFrame:
    """Mean squared-Euclidean silhouette of labellings, ``(labelling, n, silhouette)`` (A5).

    The mean squared distance of a point to a cluster follows from the
    cluster's size, sum vector and sum of squared norms, so two passes over the
    rows score every labelling, without pairs and without a shuffle of rows.
    Singletons score 0; with one cluster the score is null.
    """
    p = points.select(F.col(vector).cast("array<float>").alias("_v"),
                      F.array(*[F.col(c).cast("long") for c in labellings]).alias("_l")).dropna()
    sums = cluster_sums(p)

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            v, labels = _batch_points(pdf)
            sq = np.einsum("ij,ij->i", v, v)
            for j in range(labels.shape[1]):
                names = np.array(sorted(sums[j]))
                n, ss, total = (np.array([sums[j][c][k] for c in names]) for k in range(3))
                own = np.searchsorted(names, labels[:, j])
                at = np.arange(len(v))
                far = sq[:, None] * n + ss - 2.0 * (v @ total.T)  # summed squared distances to every cluster
                others = n[own] - 1
                a = np.where(others > 0, far[at, own] / np.maximum(others, 1), 0.0)
                mean = far / n
                mean[at, own] = np.inf
                b = mean.min(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(others == 0, 0.0, np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(a, b), 0.0))
                yield pd.DataFrame({"j": [j], "n": [len(v)], "s": [float(s.sum()) if len(names) > 1 else None]})

    parts = p.mapInPandas(run, "j int, n long, s double").groupBy("j").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))
    names = F.array(*[F.lit(c) for c in labellings])
    return parts.select(F.element_at(names, F.col("j") + 1).alias("labelling"), "n", "silhouette")


def cluster_sizes(assign: DataFrame, label: str = "label") -> DataFrame:
    """Members per cluster."""
    return assign.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def centroids(points: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per cluster ``(label, centroid ARRAY<DOUBLE>)``.

    Spark ML's ``Summarizer.mean`` aggregates whole vectors (partial per task,
    merged after one shuffle of clusters x tasks states), so no per-dimension
    rows are ever produced.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    feats = points.select(F.col(label), array_to_vector(F.col(vector).cast("array<double>")).alias("_f"))
    return feats.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_f"))).alias("centroid"))


def representatives(points: DataFrame, centres: DataFrame, texts: DataFrame, n: int = 6,
                    label: str = "label", vector: str = "embedding", chars: int = T.REPRESENTATIVE_CHARS) -> DataFrame:
    """The ``n`` members nearest to each centre, as ``- text`` lines.

    ``texts`` is ``(id, text)``; members without text are skipped. Returns
    ``(label, n_members, samples, nearest_text)``.
    """
    # rank on ids and vectors only (members without text are skipped via an
    # id-only semi-join); texts are attached to the <= n winners per cluster
    j = (points.select("id", label, vector).join(texts.select("id"), "id", "left_semi")
         .join(centres.select(label, "centroid"), label)
         .withColumn("dist", VF.l2_distance(F.col(vector), F.col("centroid"))))
    w = Window.partitionBy(label).orderBy(F.col("dist").asc(), F.col("id").asc())
    top = (j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
           .select("id", label, "_rn").join(texts.select("id", "text"), "id"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "text"))),
                        lambda s: F.concat(F.lit("- "), T.clip(s["text"], chars)))
    first = F.element_at(F.array_sort(F.collect_list(F.struct("_rn", "text"))), 1)["text"]
    return top.groupBy(label).agg(F.count(F.lit(1)).alias("n_members"),
                                  F.array_join(lines, "\n").alias("samples"), first.alias("nearest_text"))


def name_clusters(reps: DataFrame, namer: Callable[[str], str] | None = None, label: str = "label") -> DataFrame:
    """Cluster names (F2): ``namer(samples)`` per cluster, cleaned with P8.

    Without a namer the reply is the nearest member's text (its first line
    becomes the name). A failing namer gives the ``cluster <id>`` fallback.
    """
    if namer is None:
        reply = reps.select(label, F.col("nearest_text").alias("reply"))
    else:
        def run(it):
            for pdf in it:
                out = []
                for s in pdf["samples"].values:
                    try:
                        out.append(namer(s))
                    except Exception:  # noqa: BLE001 - failure -> fallback name
                        out.append(None)
                yield pd.DataFrame({label: pdf[label].values, "reply": out})
        schema = f"{label} {reps.schema[label].dataType.simpleString()}, reply string"
        reply = reps.select(label, "samples").mapInPandas(run, schema)
    return reply.select(label, T.clean_label(F.col("reply"), F.col(label)).alias("theme"))


def apply_themes(assign: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Cluster id -> theme by a left join on the (small) names table."""
    return assign.join(names.select(label, "theme"), label, "left")


def fixed_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``n`` rows chosen by the MD5 of seed and id (U4).

    Reproducible regardless of partitioning (and in any engine); planned as a
    take-ordered of ``n`` rows per task, so only those travel to the merge.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.orderBy(key, F.col(id_col)).limit(n)


def _features(points: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return points.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_clusters(points: DataFrame, k: int, seed: int = 42, vector: str = "embedding",
                 max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """k-means on all points (A7): ``(assignments(id, cluster), centres(cluster, centroid))``."""
    from pyspark.ml.clustering import KMeans
    feats = _features(points.select("id", vector), vector)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(feats)
    assign = model.transform(feats).select("id", F.col("cluster").cast("long").alias("cluster"))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = points.sparkSession.createDataFrame(rows, "cluster long, centroid array<double>")
    return assign, centres


def _near(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it) of every row."""
    d = np.einsum("ij,ij->i", centres, centres)[None, :] - 2.0 * (v @ centres.T)
    own = d.argmin(axis=1)
    return own, np.maximum(0.0, d[np.arange(len(v)), own] + np.einsum("ij,ij->i", v, v))


def _seeds(x: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ centres of weighted points."""
    def pick(w: np.ndarray) -> int:
        total = w.sum()
        return min(int(np.searchsorted(np.cumsum(w), rng.random() * total)), len(x) - 1) if total > 0 else 0

    centres = x[[pick(weight)]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        centres = np.vstack([centres, x[pick(near * weight)]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    return centres


#: Passes of the oversampling, and rows drawn in each per centre that is looked for.
OVERSAMPLING_PASSES, OVERSAMPLING = 5, 2


def oversampled_seeds(p: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, weights) of the k-means|| start over all rows of ``(id, _v)``.

    Each pass draws ``OVERSAMPLING * k`` rows in proportion to their squared
    distance from the candidates so far: a row's key is ``log(u) / d2`` with
    ``u`` a hash of seed, pass and id, and the greatest keys win, so every task
    sends on that many rows at most and the draw does not depend on the
    partitions. A last pass weighs every candidate by the rows nearest to it.
    """
    want = OVERSAMPLING * k
    first = fixed_sample(p, 1, seed).toPandas()
    centres = np.vstack(first["_v"].values).astype(np.float64)

    def draw(at: np.ndarray):
        def run(it):
            for pdf in it:
                if len(pdf):
                    v = np.vstack(pdf["_v"].values).astype(np.float64)
                    d2 = _near(v, at)[1]
                    u = (pdf["_u"].to_numpy() + 0.5) / 2.0 ** 32
                    key = np.where(d2 > 0, np.log(u) / np.where(d2 > 0, d2, 1.0), -np.inf)
                    yield pd.DataFrame({"id": pdf["id"], "_v": pdf["_v"], "key": key})
        return run

    for i in range(OVERSAMPLING_PASSES):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 32)).alias("_u")
        keyed = p.select("id", "_v", u).mapInPandas(draw(centres), "id long, _v array<float>, key double")
        drawn = keyed.filter(F.col("key") > float("-inf")).orderBy(F.desc("key"), "id").limit(want).toPandas()
        if not len(drawn):
            break
        centres = np.vstack([centres, np.vstack(drawn["_v"].values).astype(np.float64)])

    def weigh(it):
        n = np.zeros(len(centres), np.int64)
        for pdf in it:
            if len(pdf):
                n += np.bincount(_near(np.vstack(pdf["_v"].values).astype(np.float64), centres)[0], minlength=len(n))
        yield pd.DataFrame({"c": np.arange(len(n)), "n": n})

    weight = np.zeros(len(centres))
    for r in p.select("_v").mapInPandas(weigh, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        weight[r.c] = r.n
    return centres, weight


def lockstep_kmeans(p: DataFrame, ks: Sequence[int], seed: int = 42, max_iter: int = 20,
                    tol: float = 1e-4) -> dict[int, np.ndarray]:
    """k-means for several k at once, one Spark job per iteration: {k: centres}.

    ``p`` is ``(id, _v)``. All k start by k-means++ on the weighted candidates
    of one k-means|| oversampling over all rows (``oversampled_seeds``); every
    iteration assigns all rows for every k and brings back only the cluster sums.
    """
    points, weight = oversampled_seeds(p, max(ks), seed)
    rng = np.random.default_rng(seed)
    centres = {k: _seeds(points, weight, k, rng) for k in ks}
    live = list(ks)
    for _ in range(max_iter):
        if not live:
            break
        sums = cluster_sums(_assigned(p, {k: centres[k] for k in live}, [f"k{k}" for k in live]).select(
            "_v", F.array(*[f"k{k}" for k in live]).alias("_l")))
        moved = []
        for j, k in enumerate(live):
            new = centres[k].copy()
            for c, (n, _, total) in sums[j].items():
                new[c] = total / n
            if np.sqrt(((new - centres[k]) ** 2).sum(axis=1)).max() > tol:
                moved.append(k)
            centres[k] = new
        live = moved
    return centres


def _assigned(p: DataFrame, centres: dict[int, np.ndarray], names: list[str]) -> DataFrame:
    """``(id, _v)`` with the nearest centre for every k as one column each."""
    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            v = np.vstack([np.asarray(x, dtype=np.float64) for x in pdf["_v"].values])
            out = pdf[["id", "_v"]].copy()
            for name, c in zip(names, centres.values(), strict=True):
                out[name] = _near(v, c)[0].astype(np.int64)
            yield out

    return p.select("id", "_v").mapInPandas(run, ", ".join(["id long, _v array<float>", *[f"{n} long" for n in names]]))


def select_k(points: DataFrame, ks: Sequence[int] = tuple(range(8, 25, 2)), sample: int | None = None,
             seed: int = 42, vector: str = "embedding", exact: bool = False, max_iter: int = 20) -> DataFrame:
    """k sweep over all rows: silhouette per k.

    All k are fitted in lockstep and scored by the linear (squared Euclidean)
    silhouette, so the work is a few passes over the rows whatever their
    number. ``sample`` restricts the sweep to that many rows chosen by a seeded
    hash; ``exact`` scores by all pair distances instead, for samples. Returns
    ``(k, silhouette, best)``; the best k has the highest score, the smallest k
    on ties.
    """
    from tessera.session import cut_lineage
    rows = points.select("id", vector)
    rows = rows if sample is None else fixed_sample(rows, sample, seed)
    p = cut_lineage(rows.select(F.col("id").cast("long").alias("id"),
                                F.col(vector).cast("array<float>").alias("_v")).dropna())
    n = p.count()
    todo = [int(k) for k in ks if k < n]
    if not todo:
        return points.sparkSession.createDataFrame([], "k int, silhouette double, best boolean")
    names = [f"k{k}" for k in todo]
    labelled = _assigned(p, lockstep_kmeans(p, todo, seed, max_iter), names)
    scores = silhouettes(labelled, names, "_v") if exact else silhouettes_linear(labelled, names, "_v")
    res = scores.select(F.substring("labelling", 2, 10).cast("int").alias("k"), "silhouette")
    w = Window.orderBy(F.col("silhouette").desc_nulls_last(), F.col("k").asc())
    return res.withColumn("best", F.row_number().over(w) == 1)
