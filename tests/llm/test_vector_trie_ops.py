"""Nearest neighbours, conversation trie and hard negatives against plain Python versions."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<double>, label int"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))  # a shorter vector is padded with zeros


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(12)], rnd.randrange(4)) for i in range(400)]
    hot = [rnd.gauss(0, 1) for _ in range(12)]
    rows += [(400 + i, hot, 1) for i in range(250)]                                  # one vector, a third of all rows
    rows += [(700 + i, [x + rnd.gauss(0, 1e-3) for x in hot], i % 4) for i in range(60)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 12, 1), (803, [None] + [1.0] * 11, 1),
             (804, [math.nan] * 12, 1), (805, [math.inf] * 12, 1), (806, [1.0] * 12, None), (807, [2.0] * 5, 2),
             (None, [9.0] * 12, 1), (0, rows[0][1], rows[0][2]), (20, [3.0] * 12, 3)]
    return rows


def brute_nearest(rows, k):
    part = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and good(v) and any(v)})
    out = []
    for i, v in part:
        if i % 20 == 0:
            best = {}
            for j, w in part:
                if j != i:
                    best[j] = max(best.get(j, -math.inf), dot(v, w))
            near = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out += [(i, r + 1, j, s) for r, (j, s) in enumerate(near)]
    return out


def test_nearest_is_whole_where_the_forest_is_shallow(spark, vectors):
    from tessera.llm.forest import nearest
    few = vectors[:60] + vectors[400:420] + vectors[-11:]
    df = spark.createDataFrame(few, VECTORS).withColumn("score", F.lit("clash"))
    got = nearest(df, F.col("vec_id") % 20 == 0)
    expected = brute_nearest(few, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = got.collect()
    assert sorted((r.query_id, r.rank) for r in rows) == sorted((q, r) for q, r, _, _ in expected)
    key = lambda x: (x[0], x[1], round(x[3], 9), x[2])  # noqa: E731  two lists of one id may interleave
    same([(r.query_id, r.vec_id, round(r.score, 9)) for r in rows],
         [(q, v, round(s, 9)) for q, _, v, s in sorted(expected, key=key)])


def test_nearest_recall_and_hot_copies(spark, vectors):
    from tessera.llm.forest import nearest
    rows = [(r.query_id, r.rank, r.vec_id, r.score) for r in
            nearest(spark.createDataFrame(vectors, VECTORS).repartition(5), F.col("vec_id") % 20 == 0).collect()]
    expected = brute_nearest(vectors, 20)
    hit = len({(q, v) for q, _, v, _ in rows} & {(q, v) for q, _, v, _ in expected})
    assert hit >= 0.9 * len({(q, v) for q, _, v, _ in expected})
    of = {i: v for i, v, _ in vectors if i is not None and i not in (0, 20)}
    for q, _, v, s in rows:
        if q in of and v in of:
            assert s == pytest.approx(dot(of[q], of[v]), abs=1e-9)
    # a query inside the hot vector: the least ids of its copies, its own left out
    near = [v for q, _, v, s in sorted(rows) if q == 420 and s == max(x[3] for x in rows if x[0] == 420)]
    better = [v for q, _, v, _ in expected if q == 420]
    assert sorted(near)[:3] == sorted(set(near))[:3] and 420 not in near and len(set(better) & set(near)) == len(near)


def test_nearest_recall_on_the_given_table(spark):
    from tessera.llm.forest import nearest
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    pdf = df.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, -(x @ x[i])))
        true = ids[order[order != i][:20]]
        hit, total = hit + len(got[ids[i]] & set(true.tolist())), total + len(true)
    assert total == 2000 and hit >= 0.9 * total


def test_nearest_sketch_does_not_bound_the_index(spark):
    """A sketch of a few rows: every row is indexed all the same, ranges are searched whole."""
    from tessera.llm.forest import nearest
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 0) for i in range(600)]
    got = nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, sketch_rows=32).collect()
    expected = {(q, v) for q, _, v, _ in brute_nearest(rows, 20)}
    assert len({(r.query_id, r.vec_id) for r in got} & expected) >= 0.9 * len(expected)


def test_forest_prefixes():
    from tessera.llm.forest import needed, shared_prefix, stops
    rng = np.random.default_rng(0)
    sketch = np.sort(rng.integers(0, 1 << 63, (3, 200)).astype(np.uint64) * np.uint64(2), axis=1)
    strings = sketch[:, ::50].copy()
    for budget in (1, 4, 10, 50, 150, 500):
        depth = stops(sketch, strings, budget)
        for c in range(strings.shape[1]):
            held = [int((shared_prefix(sketch[t], strings[t, c]) >= depth[t, c]).sum()) for t in range(3)]
            assert sum(held) >= budget or depth[0, c] == 0
            assert depth[:, c].max() - depth[:, c].min() <= 1
    # a neighbour is inside every budget above what its search needs, and outside at it
    neighbours = sketch[:, :4].T
    shared = shared_prefix(neighbours, strings.T)
    for c, need in enumerate(needed(sketch, strings, shared)):
        assert (shared[c] >= stops(sketch, strings[:, c:c + 1], need + 1)[:, 0]).any()
        assert need == 0 or not (shared[c] >= stops(sketch, strings[:, c:c + 1], need)[:, 0]).any()


def brute_negatives(rows, positives=5, negatives=3):
    part = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
                   if i is not None and lab is not None and good(v)})
    out = []
    for i, lab, v in part:
        if i % 50:
            continue
        scored = sorted(((-dot(v, w), j, m) for j, m, w in part if j != i))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(hard)]
    return out


def test_hard_negatives(spark, vectors):
    from tessera.llm.negatives import mine_negatives
    df = spark.createDataFrame(vectors, VECTORS).withColumns({"aid": F.lit(1), "rb": F.lit("x")}).repartition(3)
    got = mine_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    same(got.collect(), brute_negatives(vectors))


def test_hard_negatives_cut_into_blocks(spark, vectors, monkeypatch):
    """Many blocks and tiles give what one gives; a label with a third of all rows is split."""
    from tessera.llm import negatives
    for name, value in {"BLOCK": 64, "SMALL": 32, "TILE_ROWS": 16, "TILE_ANCHORS": 3, "DENSE": 2.0}.items():
        monkeypatch.setattr(negatives, name, value)
    # one session: blocks are counted on the driver, tiles keep their size in the workers
    same(negatives.mine_negatives(spark.createDataFrame(vectors, VECTORS), F.col("vec_id") % 50 == 0).collect(),
         brute_negatives(vectors))


def test_hard_negatives_huge_components(spark):
    from tessera.llm.negatives import mine_negatives
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) * 2.0 ** 20 for _ in range(6)], i % 3) for i in range(120)]
    same(mine_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect(),
         brute_negatives(rows))


def test_segment_bounds_hold_and_prune():
    from tessera.llm.negatives import Block, _possible, scan
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(40, 24)) * 256)
    y = np.floor(rng.normal(size=(300, 24)) * 256)
    y[:150] += 2000  # far from the rest: segment means alone tell them apart
    x[:20] += 500
    a, b = Block(x, np.arange(40)), Block(y, np.arange(300))
    exact = x @ y.T
    low = np.sort(exact, axis=1)[:, -30]
    rows, cols, alive = _possible(a, b, low, np.full(40, np.inf), np.ones((40, 300), bool))
    kept = np.zeros((40, 300), bool)
    kept[np.ix_(rows, cols)] = alive
    assert kept[exact >= low[:, None]].all()
    assert kept[:20, 150:].mean() < 0.5  # something is really left out
    best = scan(a, b, lambda i, j: np.ones((len(i), len(j)), bool), [(np.full(40, -np.inf), np.full(40, np.inf))], 7)[0]
    for i, own in enumerate(best):
        assert own == sorted((-int(s), j) for j, s in enumerate(exact[i]))[:7]


CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(x):
        return x[:2], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()
    own = {c: [x[2:] for x in sorted(t, key=order)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(rebuilt[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rnd = random.Random(seed)
    say = [f"line {i} é" for i in range(3)] + ["", None]
    rows = []
    for c in [*range(60), -7, -5, 1000003]:
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(say)) for t in range(rnd.randint(1, 11))]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)]  # copies of one conversation
    rows += [(300, t, "user", "long") for t in range(700)] + [(301, t, "user", f"x{t % 7}") for t in range(300)]
    rows += [(5, None, "user", "no number"), (5, 0, "user", "again"), (5, 0, "user", "again"),
             (None, 0, "user", "nobody"), (7, 1, "user", "z" * 50000)]
    rnd.shuffle(rows)
    return rows


def test_prefix_trie(spark):
    from tessera.llm.prefixtrie import prefix_trie
    rows = conversations(1)
    df = spark.createDataFrame(rows, CONV).withColumns({"a": F.lit(1), "depth": F.lit("x")}).repartition(4)
    got = prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    same(got.collect(), brute_trie(rows))


def test_prefix_hashes_over_many_partitions(spark):
    """One conversation over all partitions: the running hashes are those of one partition."""
    from tessera.llm.prefixtrie import prefix_hashes, turn_key
    rows = [(1, t, "u", f"{t % 5}") for t in range(500)] + [(c, t, "u", "x") for c in (0, 2, 3) for t in range(4)]
    df = spark.createDataFrame(rows, CONV).select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"),
                                                  F.lit(1).cast("long").alias("bytes"))
    many = prefix_hashes(df.repartition(7)).collect()
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = prefix_hashes(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        scattered = prefix_hashes(df.repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    same(many, one)
    same(scattered, one)
    assert {r.pos for r in one if r.conv_id == 1} == set(range(1, 501))


def test_subtree_sums_of_random_trees(spark):
    """Chains, stars and random trees in one forest job: contraction equals a plain walk."""
    from tessera.llm.prefixtrie import subtree_sums
    rnd = random.Random(4)
    for shape in ("chain", "random", "star"):
        n = 260
        parent = {0: None}
        for v in range(1, n):
            parent[v] = v - 1 if shape == "chain" else 0 if shape == "star" else rnd.randrange(max(0, v - 4), v)
        value = {v: rnd.randrange(100) for v in parent}
        df = spark.createDataFrame([(v, -v, p, None if p is None else -p, value[v], 1) for v, p in parent.items()],
                                   "a long, b long, pa long, pb long, s long, n long")
        total, size = dict(value), dict.fromkeys(parent, 1)
        for v in sorted(parent, reverse=True):
            if parent[v] is not None:
                total[parent[v]] += total[v]
                size[parent[v]] += size[v]
        same(subtree_sums(df, ["s", "n"]).collect(), [(v, -v, total[v], size[v]) for v in parent])


def test_empty_tables(spark):
    from tessera.llm.forest import nearest
    from tessera.llm.negatives import mine_negatives
    from tessera.llm.prefixtrie import prefix_trie
    none = spark.createDataFrame([], VECTORS)
    assert nearest(none, F.col("vec_id") % 20 == 0).collect() == []
    assert mine_negatives(none, F.col("vec_id") % 50 == 0).collect() == []
    assert prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert nearest(alone, F.col("vec_id") % 20 == 0).collect() == []
    assert mine_negatives(alone, F.col("vec_id") % 50 == 0).collect() == []
