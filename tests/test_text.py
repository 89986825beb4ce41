from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_compose_text_parts(spark):
    rows = [("C", "sum", "desc"), (None, "sum", "desc"), ("", "sum", None), ("C", None, ""),
            ("C", " sum ", "nan"), (None, None, None), ("C", "s", "  d  \n")]
    got = one(spark, rows, "c string, s string, d string", T.compose_text("c", "s", "d"))
    assert got == ["[C] sum\ndesc", "sum\ndesc", "sum", "[C] ", "[C] sum\nnan", "", "[C] s\nd"]


def test_word_count_unicode_space(spark):
    rows = [("a b  c",), ("a b",), (None,), ("",), ("  x\t\ny ",)]
    assert one(spark, rows, "t string", T.word_count("t")) == [3, 2, 0, 0, 2]


def test_strip_matches_python(spark):
    vals = ["  a b  ", " x ", "\t\n", "plain"]
    got = one(spark, [(v,) for v in vals], "t string", T.strip_ws("t"))
    assert got == [v.strip() for v in vals]


def test_clean_label(spark):
    rows = [('"Network errors."\nmore', 1), ("   ", 2), (None, 3), ("x" * 50, 4), ('".."', 5),
            ("Line one\r\nLine two", 6)]
    got = one(spark, rows, "r string, c int", T.clean_label("r", "c"))
    assert got == ["Network errors", "cluster 2", "cluster 3", "x" * 40, "", "Line one"]


def test_map_severity(spark):
    rows = [(" Major ",), ("S3",), ("trivial",), ("--",), (None,)]
    assert one(spark, rows, "s string", T.map_severity("s")) == ["high", "med", "low", None, None]


def test_clip_and_year(spark):
    assert one(spark, [("abcdef",)], "s string", T.clip("s", 3)) == ["abc"]
    assert one(spark, [("2019-05-01T10:00:00Z",), ("bad",)], "s string", T.year_of("s")) == [2019, None]


def test_binarise_and_as_id(spark):
    assert one(spark, [(5,), (4,), (None,)], "s int", T.binarise_score("s")) == [1, 0, 0]
    assert one(spark, [("12",), ("x",)], "s string", T.as_id("s")) == [12, None]


def test_word_hashes_equal_crc32_per_word(monkeypatch):
    import random
    import zlib

    import numpy as np
    import pyarrow as pa

    from tessera.operators import embed

    def plain(texts, dims):
        fold = bytes(embed._FOLD)
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            h = np.array([zlib.crc32(w) for w in (t or "").encode().translate(fold).split()], np.uint64)
            pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(16)
            out[i] = np.bincount((np.concatenate([h, pairs]) % np.uint64(dims)).astype(np.int64), minlength=dims)
        return out

    rnd = random.Random(0)
    texts = [None, "", " ", "a", "Hello, World_1 é漢字", "x" * 500 + " y " + "z" * 64 + " " + "w" * 65, "\n\n", "end ", " go"]
    texts += ["".join(rnd.choice("ab é,_Z9\n") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    for size in (1 << 20, 300, 1):
        monkeypatch.setattr(embed, "SLICE_BYTES", size)
        for column in (pa.array(texts), pa.array(texts).slice(3, 100), pa.array(texts, pa.large_string())):
            assert (embed._counts(column, 64) == plain(column.to_pylist(), 64)).all()
    assert embed._counts(pa.array([], pa.string()), 8).shape == (0, 8)
