"""Quoted CSV read by many tasks per file, held to Python's csv module and to Spark's one-task reader."""

import csv
import io
import random
import re
import tempfile
from contextlib import contextmanager

import pytest
from pyspark.sql import types as T

from tessera.sources import quoted as QC
from tessera.sources import readers as RD

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()),
                       T.StructField("b", T.StringType())])


@contextmanager
def block_bytes(spark, n):
    keys = {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(folder, name, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows([["id", 'na"me\nof a', "b"], *rows])
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue())
    return out.getvalue()


def random_rows(seed, n, end="\n"):
    r = random.Random(seed)
    bits = ["x", ",", '"', end, "é", " ", '""', end * 2, "long words here"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(9)))
    return [[i, text(), text()] for i in range(n)]


def read(spark, folder):
    rows = QC.read_quoted_csv(spark, folder, SCHEMA, **RD._CSV_OPTIONS).collect()
    return sorted((r.id, r.a or "", r.b or "") for r in rows)


def test_every_block_border(spark):
    """A small file cut at every length: each border falls on every byte of quotes, breaks and fields."""
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    rows = [[1, 'say "hi",\nand\n\nleave', ""], [2, '"', '\n'], [3, "plain", 'a""b'], [4, '\n"\n', "é"], [5, "", "end\n"]]
    text = write(folder, "f.csv", rows)
    for n in range(3, len(text.encode()) + 2):
        with block_bytes(spark, n):
            assert read(spark, folder) == [tuple(r) for r in rows], n


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_one_task_reader(spark, end):
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    rows = [random_rows(s, 60, end) for s in range(3)]
    for s, part in enumerate(rows):
        write(folder, f"{s}.csv", [[s * 1000 + r[0], *r[1:]] for r in part], end)
    want = sorted((s * 1000 + i, a, b) for s, part in enumerate(rows) for i, a, b in part)
    for n in (64, 200, 1 << 20):
        with block_bytes(spark, n):
            assert read(spark, folder) == want
    if end == "\n":
        one = RD._csv(spark, folder, SCHEMA).collect()
        assert sorted((r.id, r.a or "", r.b or "") for r in one) == want


def test_a_record_longer_than_many_blocks(spark):
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    long = "\n".join(f'line {i} "quoted", and more' for i in range(300))
    write(folder, "f.csv", [[1, "x", "y"], [2, long, long], [3, "z", ""]])
    with block_bytes(spark, 500):
        assert QC._lines(spark, folder).select("block").distinct().count() > 20
        assert read(spark, folder) == [(1, "x", "y"), (2, long, long), (3, "z", "")]


def test_blank_lines_empty_files_and_headers(spark):
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    for name, text in (("empty.csv", ""), ("head.csv", "id,a,b\n"), ("blank.csv", "\n\nid,a,b\n\n1,x,\n\n2,,y")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    with block_bytes(spark, 6):
        assert read(spark, folder) == [(1, "x", ""), (2, "", "y")]


@pytest.mark.parametrize("body", ['1,a"b,c\n2,x,y\n', '1,"open\n2,x,y\n', '1,"a"b,c\n', '1,a,"b" \n'])
def test_other_quotes_fail_with_the_file_name(spark, body):
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    with open(f"{folder}/strange.csv", "w") as f:
        f.write("id,a,b\n" + body)
    with pytest.raises(Exception, match="strange.csv"):
        read(spark, folder)


def test_the_count_of_quotes_sends_one_row_per_block_on(spark):
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    write(folder, "f.csv", random_rows(9, 400))
    with block_bytes(spark, 1000):
        lines = QC._lines(spark, folder)
        blocks = lines.select("block").distinct().count()
        assert blocks > 5 and QC.block_states(lines).count() == blocks
        execution = QC.block_states(lines)._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = execution.explainString(mode)
    # hash aggregates before and after an exchange of a block's place and three numbers
    assert execution.executedPlan().toString().count("HashAggregate") == 2 and "SortAggregate" not in plan
    sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and all("value" not in s for s in sent) and sent[0].startswith("file#")


def test_lines_are_shuffled_once(spark):
    """The branches of the plan share the exchange of the lines; what else moves are pieces at borders."""
    folder = tempfile.mkdtemp(prefix="tessera-test-")
    write(folder, "f.csv", random_rows(10, 400))
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        plan = QC.csv_records(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # without the reused ones: the counts of quotes by block and by file, their states, the lines, the pieces at borders
    made = [re.sub(r"#\d+L?", "", by) for head, by in re.findall(r"(.*)Exchange hashpartitioning\(([^)]*)\)", plan)
            if "ReusedExchange" not in head]
    assert sorted(made) == ["file, 8", "file, begin, 8", *["file, block, 8"] * 3], plan
