import numpy as np
import pytest

from tessera.operators import vectors as V
from tessera.operators.retrieval import pair_ranks, retrieval_metrics


def brute_topk(ids, mat, k):
    m = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    s = m @ m.T
    out = {}
    for i, q in enumerate(ids):
        cand = [(-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != q]
        cand.sort()
        out[q] = [c[1] for c in cand[:k]]
    return out


def vec_df(spark, ids, mat):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)],
                                 "id long, embedding array<float>")


@pytest.mark.parametrize("block_bytes,parts", [(32 << 20, 5), (4096, 5), (700, 1)])
def test_knn_matches_brute_force(spark, block_bytes, parts):
    rng = np.random.default_rng(7)
    ids = np.arange(300) * 3 + 1
    mat = rng.normal(size=(300, 16)).astype(np.float32)
    df = vec_df(spark, ids, mat)
    q = df.filter("id < 400")
    got = V.knn_join(q, df.repartition(parts), k=5, query_block_bytes=block_bytes * 16).collect()
    exp = brute_topk(ids, mat.astype(np.float64), 5)
    res = {}
    for r in got:
        res.setdefault(r.qid, []).append((r.rank, r.id))
    assert len(res) == 133
    for i, lst in res.items():
        assert [x for _, x in sorted(lst)] == exp[i]


def test_knn_ties_by_id_and_self_excluded(spark):
    mat = np.array([[1, 0], [1, 0], [1, 0], [0, 1]], dtype=np.float32)
    df = vec_df(spark, [10, 30, 20, 40], mat)
    got = sorted((r.qid, r.rank, r.id) for r in V.knn_join(df, df.repartition(3), k=2).collect())
    assert [(r, i) for q, r, i in got if q == 10] == [(1, 20), (2, 30)]
    assert all(q != i for q, _, i in got)


def test_knn_same_rows_for_all_blocks_and_partitions_on_thousands_of_copies(spark):
    v = np.random.default_rng(5).normal(size=(1, 24)).astype(np.float32)
    df = vec_df(spark, np.arange(2500), np.repeat(v, 2500, axis=0))
    q = df.filter("id % 50 = 0")
    runs = [sorted(tuple(r) for r in V.knn_join(q, df.repartition(n), k=5, query_block_bytes=b).collect())
            for n, b in ((1, 32 << 20), (7, 32 << 20), (3, 2000))]
    assert runs[0] == runs[1] == runs[2]
    assert [r[2] for r in runs[0] if r[0] == 2450] == [0, 1, 2, 3, 4]


def test_top_k_bounded_and_exact_under_ties():
    from tessera.operators import topk
    v = np.ones((9000, 8))
    i, ids, _ = topk.top_k(np.arange(200), v[:200], np.arange(9000)[::-1], v, 10, True)
    assert len(i) == 2000 and set(np.bincount(i)) == {10}
    assert ids[i == 0].tolist() == list(range(1, 11)) and ids[i == 5].tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_top_k_score_is_the_same_in_any_tile(monkeypatch):
    from tessera.operators import topk
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(70, 24)), rng.normal(size=(500, 24))
    whole = topk.top_k(np.arange(70), q, np.arange(500), c, 6, False)
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "TILE_QUERIES", 3)
    for a, b in zip(whole, topk.top_k(np.arange(70), q, np.arange(500), c, 6, False), strict=True):
        assert np.array_equal(a, b)


def test_knn_plan_does_not_grow_with_the_queries(spark):
    """One grid join for any number of query blocks; no query passes the driver."""
    import inspect
    df = vec_df(spark, range(300), np.random.default_rng(1).normal(size=(300, 8)))
    few, many = (V.knn_join(df, df, k=3, query_block_bytes=b, corpus_block_bytes=c)._jdf.queryExecution()
                 .optimizedPlan().toString() for b, c in ((32 << 20, 128 << 20), (640, 4000)))
    assert few.count("\n") == many.count("\n") and many.count("FlatMapCoGroupsInArrow") == 1
    assert "toPandas" not in inspect.getsource(V) and "broadcast(" not in inspect.getsource(V)


def test_knn_zero_vector_returns_k_rows(spark):
    df = vec_df(spark, [1, 2, 3], np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]))
    got = sorted((r.qid, r.rank, r.id, r.sim) for r in V.knn_join(df, df, k=2).collect() if r.qid == 1)
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, 0.0)]


def test_knn_independent_of_partitions(spark):
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(120, 8))
    df = vec_df(spark, range(120), mat)
    a = sorted(tuple(r) for r in V.knn_join(df.repartition(1), df, k=3).collect())
    b = sorted(tuple(r) for r in V.knn_join(df.repartition(7), df.repartition(3), k=3).collect())
    assert a == b


def test_near_duplicates_rounding(spark):
    nn = spark.createDataFrame([(1, 1, 2, 0.7496), (1, 2, 3, 0.7494), (1, 3, 4, 0.9)],
                               "qid long, rank int, id long, sim double")
    got = [(r.id, r.sim3) for r in V.near_duplicates(nn, 0.75, 5).orderBy("rank").collect()]
    assert got == [(2, 0.75), (4, 0.9)]


def test_retrieval_metrics_hand_pairs(spark):
    nn = spark.createDataFrame([(1, r, 100 + r, 1.0 - r / 100) for r in range(1, 11)] +
                               [(2, r, 200 + r, 1.0 - r / 100) for r in range(1, 11)],
                               "qid long, rank int, id long, sim double")
    pairs = spark.createDataFrame([(1, 101), (2, 206), (1, 150), (1, 1), (1, 101)], "dup_id long, master_id long")
    m = retrieval_metrics(pair_ranks(pairs, nn)).first()
    assert m.n_pairs == 5
    assert abs(m.hit_at_1 - 2 / 5) < 1e-12 and abs(m.hit_at_5 - 2 / 5) < 1e-12
    assert abs(m.hit_at_10 - 3 / 5) < 1e-12
    assert abs(m.mrr - (1 + 1 + 1 / 6) / 5) < 1e-12
    assert m.hit_at_1 <= m.mrr <= m.hit_at_10


def test_knn_skips_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 1.0])],
                               "id long, embedding array<float>")
    got = sorted((r.qid, r.id) for r in V.knn_join(df, df, k=2).collect())
    assert got == [(1, 2), (2, 1)]


def test_knn_k_larger_than_corpus(spark):
    df = vec_df(spark, [1, 2, 3], np.array([[1.0, 0.0], [0.8, 0.2], [0.0, 1.0]]))
    got = sorted((r.qid, r.rank, r.id) for r in V.knn_join(df, df, k=10).collect())
    assert [(q, i) for q, _, i in got if q == 1] == [(1, 2), (1, 3)]
    assert len(got) == 6


def peak_mb(fn):
    import tracemalloc
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


def test_memory_of_a_block_with_many_equal_vectors():
    """1.2 million pairs tie in the tile: they are scored a bounded number at a time."""
    from tessera.operators import topk
    v = np.ones((3000, 64), np.float32)
    got = []
    assert peak_mb(lambda: got.append(topk.top_k(np.arange(400), v[:400], np.arange(3000), v, 5, True))) < 300
    i, ids, sims = got[0]
    assert ids.reshape(400, 5)[0].tolist() == [1, 2, 3, 4, 5] and ids.reshape(400, 5)[9].tolist() == [0, 1, 2, 3, 4]
    assert len(set(sims.tolist())) == 1 and abs(sims[0] - 1) < 1e-9


def test_close_neighbours_are_told_apart_in_float64():
    """Similarities that agree in float32 still rank exactly."""
    from tessera.operators import topk
    rng = np.random.default_rng(5)
    c = np.ones((9000, 32)) + rng.normal(0, 1e-4, (9000, 32))
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    _, ids, _ = topk.top_k(np.arange(50), c[:50], np.arange(9000), c, 10, False)
    want = np.argsort(-(u[:50].astype(np.longdouble) @ u.T.astype(np.longdouble)), axis=1, kind="stable")[:, :10]
    assert (ids.reshape(50, 10) == want).mean() > 0.99
