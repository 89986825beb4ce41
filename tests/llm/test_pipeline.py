"""Every pipeline stage on what its predecessor kept, held to brute force."""

import re
import sys

import brute
import corpus_pipeline
import pytest

from tessera.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality long, toxic long").write.parquet(
        str(base / "labels.parquet"))
    first = docs.filter("doc_id = 2").first().text
    spark.createDataFrame([(1, " ".join(first.split()[5:40])), (2, None)], "item_id long, text string").write.parquet(
        str(base / "benchmark.parquet"))
    return str(base)


def staged(spark, folder, tmp_path):
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def listed(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def count(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def passages_gone(docs):
    """Bytes that the passage stage cuts from each document, by plain search."""
    size, words = corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS
    seen, texts = {}, {d: (t or "").encode() for d, t in docs}
    for d, t in texts.items():
        for i in range(len(t) - size + 1):
            seen.setdefault(t[i:i + size], []).append((d, i))
    mask = {d: [False] * len(t) for d, t in texts.items()}
    for found in seen.values():
        if len(found) > 1:
            for d, i in found:
                mask[d][i:i + size] = [True] * size
    out = {}
    for d, t in texts.items():
        gone = i = 0
        while i < len(t):
            j = i
            while j < len(t) and mask[d][j]:
                j += 1
            if j > i:
                runs = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", t) if i <= m.start() and m.end() <= j]
                if len(runs) >= words or j - i >= 400:
                    gone += runs[-1][1] - runs[0][0] if runs else len(whole(t, i, j))
            i = max(j, i + 1)
        out[d] = gone
    return out


def whole(t, i, j):
    """The run widened to whole characters."""
    while i > 0 and t[i] & 0xC0 == 0x80:
        i -= 1
    while j < len(t) and t[j] & 0xC0 == 0x80:
        j += 1
    return t[i:j]


def test_planted_passages_of_little_over_50_words_go_and_shorter_ones_stay(spark, tmp_path):
    import random
    rnd = random.Random(11)

    def text(n):
        return " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(n))

    planted = [text(n) for n in (51, 52, 55, 58, 61, 65)]
    short = [text(n) for n in (20, 30, 40, 48)]
    rows, want = [], {}
    for i in range(60):
        a, b = text(80), text(70)
        mid = planted[i % 6] if i % 3 else short[i % 4]
        rows.append((i, f"{a}\n{mid}\n{b}"))
        want[i] = (mid, bool(i % 3))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = corpus_pipeline.repeated_passages(spark, spark.read.parquet(path), "").collect()
    assert len(got) == 60
    for r in got:
        passage, goes = want[r.doc_id]
        assert (passage in r.text) is not goes
        assert len(r.text.split()) == (150 if goes else 150 + len(passage.split()))


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_passages", "benchmark_decontamination", "source_mix"]
    t = staged(spark, folder, tmp_path)
    assert all(x.columns == COLUMNS for x in t[:-1])
    raw, good, single, cut, clean = (listed(x) for x in t[:5])
    # 7: every row it keeps is an input row that passes the base rules
    assert all(count(raw)[r] >= n for r, n in count(good).items())
    assert good and not any(brute.statistics(r[1])[5] for r in good)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge_quality(t[0], labels)
    assert len(good) == judged.filter("kept").count()
    # 1: one document of each component, that of the least id
    groups = {}
    for (d, _, comp), r in zip(brute.components([(r[0], r[1]) for r in good]), good, strict=True):
        groups.setdefault(comp, []).append(r)
    assert len(single) == len(groups)
    assert sorted(r[0] for r in single) == sorted(min(x[0] for x in g if x[0] is not None) for g in groups.values())
    # 4: texts without their repeated passages of over 50 words, all rows kept
    gone = passages_gone([(r[0], r[1]) for r in single])
    assert sorted(r[0] for r in cut) == sorted(r[0] for r in single)
    before = {r[0]: r[1] for r in single}
    assert all(len(before[r[0]].encode()) - len(r[1].encode()) == gone[r[0]] for r in cut)
    # 6: contaminated documents go
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.contamination([(r[0], r[1]) for r in cut], items) if x[5]}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in cut if r[0] not in bad)
    # 2: a size and a share for every document that is left
    mix = t[5].collect()
    assert len(mix) == len(clean) and all(0 <= r.taken <= 2 * r.size for r in mix)


def test_run_and_odd_tables(spark, folder, tmp_path):
    import os

    from tessera.session import checkpoint_dir
    rows = corpus_pipeline.run(spark, folder)
    left = [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("corpus-pipeline")]
    assert not any(os.listdir(f"{checkpoint_dir(spark).removeprefix('file:')}/{x}") for x in left)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and rows.count() > 0
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    path = str(tmp_path / "e.parquet")
    empty.write.parquet(path)
    empty = spark.read.parquet(path)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (i == 4 or out.columns == COLUMNS)
    # nulls, repeated rows and columns whose names the operators use
    wide = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "n_chars AS row", "'k' AS kept", "doc_id AS n_words", "source AS keep", "lang AS component", "1 AS seg")
    wide.write.parquet(str(tmp_path / "w.parquet"))
    wide = spark.read.parquet(str(tmp_path / "w.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and out.count() > 0
    assert stage is not None and "corpus_pipeline" in sys.modules


def test_replacement_characters_of_the_text_stay(spark, tmp_path):
    import corpus_pipeline
    passage = "".join(f"w{i} " for i in range(120))
    texts = [f"a\ufffdb é{passage}漢 one\ufffd", f"two\ufffd é{passage}漦 c"]  # é shared, the last characters share two bytes
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, spark.read.parquet(path), "").collect()}
    assert got == {0: "a\ufffdb  漢 one\ufffd", 1: "two\ufffd  漦 c"}  # only whole words go
    # a run without a whole word goes with the character that its end cuts in half
    passage = passage.replace(" ", "_")
    texts = [f"a\ufffdb{passage}漢one\ufffd", f"two\ufffd{passage}漦c"]
    path = str(tmp_path / "unspaced.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, spark.read.parquet(path), "").collect()}
    assert got == {0: "a\ufffdbone\ufffd", 1: "two\ufffdc"}
