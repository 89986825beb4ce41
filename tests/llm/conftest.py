import os
import random
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    s = local_session(4, shuffle_partitions=4, app="tessera-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-test-"))
    yield s


def sentence(rnd, n, words=400):
    return " ".join(f"w{rnd.randint(0, words)}" for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source) rows: copies, near copies, shared passages and every odd case."""
    rnd = random.Random(seed)
    base = [sentence(rnd, rnd.randint(60, 160)) for _ in range(12)]
    passage = sentence(rnd, 90)
    rows = []
    for i in range(n):
        b = rnd.choice(base)
        w = b.split()
        kind = i % 6
        if kind == 0:
            text = b
        elif kind == 1:
            w[rnd.randrange(len(w))] = "edited"
            text = " ".join(w)
        elif kind == 2:
            text = sentence(rnd, 70) + "\n" + passage + "\n" + sentence(rnd, 30)
        elif kind == 3:
            for _ in range(len(w) // 20):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
            text = " ".join(w).upper()
        elif kind == 4:
            text = sentence(rnd, rnd.randint(1, 8))
        else:
            text = "é漢 ｗ" * rnd.randint(1, 150) + sentence(rnd, 40, 20)
        rows.append((i, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "Ü", None])))
    odd = [(100, None, "en", "a"), (101, "", "en", "b"), (102, " \t\n\x0b\f\r ", None, None), (103, base[0], "fr", "a"),
           (103, base[0], "fr", "a"), (None, base[1], "en", None), (None, None, None, None),
           (104, "a b c d e", "en", "b"), (105, "a b c d e", "en", "b"), (106, "A b\tc D", "en", "b"),
           (107, "a b c d", "en", "b"), (108, "z " * 30000, "en", "a"), (109, sentence(rnd, 20000), "en", "a"),
           (110, "\x00<|endoftext|> 'll 　 x\U0001F642", "fr", "b")]
    return rows + odd


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The corpus as a table read as it lies, over several files."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    data = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, expected):
    """Equal as multisets of rows."""
    a, b = sorted(map(tuple, got), key=key), sorted(map(tuple, expected), key=key)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
