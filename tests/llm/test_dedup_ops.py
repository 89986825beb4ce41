"""Jaccard join, repeated substrings and decontamination against brute force."""

import random

import brute
import numpy as np
import pytest
from conftest import same, sentence

from tessera.llm import decontam, jaccard, substrings


def pairs(rows):
    return [(d, t) for d, t, *_ in rows]


def test_components_match_brute_force(spark, docs, rows):
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), brute.components(pairs(rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_families(spark, seed, tmp_path):
    rnd = random.Random(seed)
    data = []
    for f in range(6):
        w = sentence(rnd, rnd.randint(20, 80), 3000).split()
        for _ in range(14):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = f"e{rnd.randint(0, 99)}"
            data.append((len(data), " ".join(v[:rnd.randint(len(v) * 3 // 4, len(v))])))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(path)
    got = jaccard.near_duplicates(spark.read.parquet(path)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), brute.components(data))


def test_components_keep_clashing_columns_out(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8)],
                               "doc_id long, text string, row int, sig int")
    got = jaccard.near_duplicates(df).select("doc_id", "component_id").collect()
    same(got, [(1, 1), (2, 1)])


def test_tree_join_loses_no_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(150):
        base = rng.choice(4000, size=rng.integers(5, 60), replace=False)
        sets.append(base)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > .08], rng.integers(0, 4000, 2)])))
    vec = np.array([np.bincount(s % 128, minlength=128) for s in sets])
    n = np.array([len(s) for s in sets])
    i, j = jaccard.rtree_join((vec, n), (vec, n))
    found = set(zip(i.tolist(), j.tolist()))
    links = 0
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                links += a != b
                assert (a, b) in found
    assert links > 50 and len(found) < len(sets) ** 2 / 4


def test_open_edges_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 5, size=(40, 512)).astype(np.uint32)
    v = np.concatenate([v, v])
    rows = [(1, 80, 1, i, i % 7, int(x.sum()), bytearray(jaccard.pack_counts(x[None])[0])) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cell long, size long, weight long, sig long, comp long, n long, vec binary")
    for block in (1024, 9):
        comp = {r.node: r.comp for r in jaccard.components(jaccard.open_edges(df, block=block)).collect()}
        # twins of different components are in one family
        assert all(comp.get(i, i) == comp.get(i + 40, i + 40) for i in range(40))
    led = {tuple(r) for r in jaccard.leaders(df.withColumn("comp", df["sig"])).collect()}
    assert {(i, i + 40) for i in range(40)} <= led


def test_packed_counts_never_fall_short():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 300, (6, 512)) * np.array([[1], [1], [0], [700], [40], [9]])
    back = jaccard.unpack_counts(jaccard.pack_counts(counts)).astype(np.int64)
    assert (back >= counts).all() and (back[2] == 0).all()
    small = rng.integers(0, 256, (3, 512))
    assert (jaccard.unpack_counts(jaccard.pack_counts(small)) == small).all()
    assert (jaccard.fold_counts(small.astype(np.uint16)).sum() == small.sum())


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (200, 200)] + \
        [(300, 300 + i) for i in range(1, 60)] + [(rnd.randint(1000, 1100), rnd.randint(1000, 1100)) for _ in range(60)]
    got = {r.node: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    assert got == want


@pytest.mark.parametrize("length", [400, 60])
def test_repeats_match_brute_force(spark, docs, rows, length):
    got = substrings.remove_repeats(docs, length=length, segment_bytes=20_000)
    own = [r for r in pairs(rows) if r[0] != 108]  # 30,000 equal words are slow to check by force
    out = got.select("keep.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute.repeats(own, length)
    assert len(out) == len(rows)
    same([r for r in out if r.doc_id != 108], want)
    long = next(r for r in out if r.doc_id == 108)
    assert (long.n_bytes, long.n_removed, long.n_spans) == (60000, 60000, 1)


def test_passages_are_counted_and_removal_stays_at_400_bytes(spark, rows, tmp_path):
    """Passages of little over 50 words under 400 bytes are told, though only 400-byte strings are removed."""
    from test_pipeline import passages_gone

    from tessera.llm import queries
    rnd = random.Random(7)
    planted = [sentence(rnd, n) for n in (51, 54, 58)]
    brief = [sentence(rnd, n) for n in (45, 49)]
    assert all(200 < len(p) < 400 for p in planted + brief)
    own = [r for r in pairs(rows) if r[0] is not None and r[0] != 108]
    own = list({d: (d, t) for d, t in own}.values())
    for i, mid in enumerate(planted + brief + planted + brief + [sentence(rnd, 54)]):
        own.append((9000 + i, f"{sentence(rnd, 60)}\n{mid}\n{sentence(rnd, 40)}"))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(own, "doc_id long, text string").repartition(4).write.parquet(path)
    got = queries.QUERIES["op4_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    found = got.collect()
    same([tuple(r)[:5] for r in found], brute.repeats(own))
    told = {r.doc_id: r.n_passage_bytes for r in found}
    assert told == passages_gone(own)
    assert [told[9000 + i] > 0 for i in range(11)] == [True] * 3 + [False] * 2 + [True] * 3 + [False] * 3
    assert all(r.n_removed == 0 for r in found if r.doc_id >= 9000)


@pytest.mark.parametrize("passage", [(60, 5), (250, 51), (400, 51)])
def test_passages_change_nothing_else(spark, docs, passage):
    cols = ["keep.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    plain = substrings.remove_repeats(docs, segment_bytes=20_000).select(*cols).collect()
    with_passages = substrings.remove_repeats(docs, segment_bytes=9_000, passage=passage)
    same(with_passages.select(*cols).collect(), plain)
    want = substrings.remove_repeats(docs, passage[0], segment_bytes=20_000, words=passage[1])
    same(with_passages.select("keep.doc_id", "n_passage_bytes").collect(),
         [tuple(r) for r in want.select("keep.doc_id", "n_removed").collect()])


def test_a_passage_longer_than_the_strings_is_refused(spark, docs):
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, length=100, passage=(200, 51))


def test_texts_are_shuffled_once(spark, docs):
    found = substrings.remove_repeats(docs, passage=(200, 51))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    texts = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len([line for line in texts if "ReusedExchange" not in line]) == 1 < len(texts)


def test_repeats_do_not_depend_on_segments(spark, docs):
    cols = ["keep.doc_id", "n_removed", "kept_sha256"]
    a = substrings.remove_repeats(docs, segment_bytes=5_000).select(*cols).collect()
    b = substrings.remove_repeats(docs.repartition(5), segment_bytes=1 << 20).select(*cols).collect()
    same(a, b)


def test_level_family_counts():
    rng = np.random.default_rng(2)
    family = substrings.LevelFamily()
    core, stretch = rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 3, 400).astype(np.uint64)
    for i in range(0, 400, 25):
        family.insert(core[i:i + 25], stretch[i:i + 25], np.ones(25, np.int64))
    assert len(family.levels) == 1 and family.levels[0][0] == 4  # sixteen equal batches are one level
    other, own = family.scan(core, stretch)
    for k in range(400):
        peers = stretch[core == core[k]]
        assert other[k] == (len(set(peers.tolist())) > 1) and own[k] == min(2, (peers == stretch[k]).sum())


ITEMS = [(1, sentence(random.Random(9), 40)), (2, "w1 w2 w3"), (3, None), (4, " .,;"), (None, "w4 w5"),
         (5, "W1, w2; W3!"), (5, "W1, w2; W3!"), (6, "é漢 ｗé漢 ｗé漢")]


def test_contamination_matches_brute_force(spark, docs, rows):
    items = spark.createDataFrame(ITEMS + [(7, rows[2][1])], "item_id long, text string")
    want = brute.contamination(pairs(rows), ITEMS + [(7, rows[2][1])])
    from pyspark.sql import functions as F
    for options in ({}, {"segment_words": 300}, {"block_bytes": 200}):
        got = decontam.decontaminate(docs, items, **options).select(
            "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
        same(got.collect(), want)


def test_full_index_and_proximity(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(0, "a b x c d"), (1, "a b c d"), (2, "d c b a"), (3, None)], "row long, text string") \
        .coalesce(1).write.parquet(path)
    index = decontam.build_index(spark.read.parquet(path))
    phrase = [(b"a", b"b", b"c", b"d")]
    exact = {r.row: r["items"] for r in decontam.search(index, phrase, [["q"]]).collect()}
    near = {r.row: r["items"] for r in decontam.search(index, phrase, [["q"]], slop=1).collect()}
    assert exact == {0: [], 1: ["q"], 2: [], 3: []} and near == {0: ["q"], 1: ["q"], 2: [], 3: []}


def test_empty_tables(spark, empty, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert decontam.decontaminate(empty, none).count() == 0
    got = decontam.decontaminate(docs, none).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_hit for r in got)
