"""Quoted CSV with line breaks inside its fields, read by many tasks per file.

Spark cuts a plain text file into blocks at line ends, but a multi-line CSV file
goes to one task, since a line break may stand inside quotes. Whether it does
depends only on how many quotes come before it in the file:

1. a narrow pass counts, per block, the parity of its quotes and its last line
   with an odd number of them (one row per block leaves a task);
2. sums over the blocks of a file say in which state each block begins and, if
   inside a record, in which block and line that record began;
3. inside a block, running parities tell the lines that begin a record. A line
   that is a whole record is parsed where it is; the lines of the others are
   brought together by the line that began them, also across blocks.

A block is at most ``spark.sql.files.maxPartitionBytes`` long, so no task holds
a file; the largest group is one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, block and place: (file, block, seq, value, odd).

    ``seq`` rises along a block and is the same in every scan of the same files.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
        (F.regexp_count("value", F.lit('"')) % 2).cast("int").alias("odd"))


def _blank(value: Column) -> Column:
    return value.isin("", "\r")


def block_states(lines: DataFrame) -> DataFrame:
    """Per block: ``inside`` (0 or 1) at its first line, the block and line ``open_block``, ``open_seq``
    where the record open there began, the line ``tail_seq`` of the block that began the record open at
    its end, the file's header line ``head_seq``, and ``torn`` when the file's quotes do not pair up."""
    blocks = lines.groupBy(_BLOCK).agg(
        (F.sum("odd") % 2).alias("odd"), F.max(F.when(F.col("odd") == 1, F.col("seq"))).alias("last_odd"),
        F.min(F.when(~_blank(F.col("value")), F.col("seq"))).alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    states = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    # the last odd line of a block that ends inside a record is the one that opened it
    opened = F.when(((F.col("inside") + F.col("odd")) % 2 == 1) & F.col("last_odd").isNotNull(),
                    F.struct("block", F.col("last_odd").alias("seq")))
    states = states.withColumn("opened", opened).withColumns({
        "open": F.last("opened", ignorenulls=True).over(before),
        "head_seq": F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).over(whole)["first"],
        "torn": F.sum("odd").over(whole) % 2 == 1})
    return states.select(*_BLOCK, "inside", F.col("open.block").alias("open_block"),
                         F.col("open.seq").alias("open_seq"), F.col("opened.seq").alias("tail_seq"), "head_seq", "torn")


def _misplaced(value: Column, inside: Column) -> Column:
    """True where a quote stands neither at a field's border nor doubled inside quotes."""
    def bad(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def piece_bad(p: Column, j: Column) -> Column:
            left = (j == 0) | p.startswith(",") | (p == "") | ((j == last) & (p == "\r"))
            right = (j == last) | p.endswith(",") | (p == "")
            return ((inside + j) % 2 == 0) & ~(left & right)
        return F.exists(F.transform(pieces, piece_bad), lambda b: b)
    return F.contains(value, F.lit('"')) & bad(F.split(value, '"', -1))


def _joined(place: str, value: str) -> Column:
    """Aggregate: the texts by their place, with line breaks between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda p: p[value]), "\n")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under ``path`` as text: (file, value), headers and blank lines left out.

    Quoting is RFC 4180: a quote opens or closes a whole field, or is doubled
    inside one. Lines end with LF or CRLF (the CR before a record's end is no
    data); LF and CRLF inside quotes stay as they are. Other quotes, also one
    never closed, fail the job with the file's name before any lines are
    brought together: the one-task reader decides such files. The first line
    of each file that is not blank begins its header. Compressed files are one
    block each. Empty files and folders give no record.
    """
    lines = _lines(spark, path)
    run = Window.partitionBy(*_BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.join(block_states(lines), _BLOCK).withColumn(
        "inside", (F.col("inside") + F.coalesce(F.sum("odd").over(run), F.lit(0))) % 2)
    begin = F.last(F.when(F.col("inside") == 0, F.struct("block", "seq")), ignorenulls=True).over(upto)
    rows = rows.withColumn("begin", F.coalesce(begin, F.struct(
        F.col("open_block").alias("block"), F.col("open_seq").alias("seq"))))
    error = F.raise_error(F.concat(F.lit("quotes do not follow RFC 4180, read it with parallel=False: "), F.col("file")))
    rows = rows.withColumn("value", F.when(F.col("torn") | _misplaced(F.col("value"), F.col("inside")),
                                           error.cast("string")).otherwise(F.col("value")))
    rows = rows.filter(F.col("begin.seq") != F.col("head_seq"))
    edge = (F.col("begin.block") != F.col("block")) | F.coalesce(F.col("begin.seq") == F.col("tail_seq"), F.lit(False))
    rows = rows.withColumn("edge", edge)
    # a one-line record is never at an edge; asking for it keeps the columns, so that all branches share one exchange
    one = (F.col("inside") == 0) & (F.col("odd") == 0) & ~F.col("edge")
    single = rows.filter(one & ~_blank(F.col("value"))).select("file", "value")
    # lines lie by (file, block) since the windows, so this grouping moves nothing
    pieces = rows.filter(~one).groupBy(*_BLOCK, "begin", "edge").agg(_joined("seq", "value").alias("value"))
    whole = pieces.filter(~F.col("edge"))
    cut = pieces.filter("edge").groupBy("file", "begin").agg(_joined("block", "value").alias("value"))
    records = single.unionByName(whole.select("file", "value")).unionByName(cut.select("file", "value"))
    return records.select("file", F.regexp_replace("value", "\r$", "").alias("value"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """The files as rows of ``schema`` (columns by position, as ``spark.read.csv`` with a schema)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    opts = {k: str(v) for k, v in options.items() if k != "header"} | {"multiLine": "true", "lineSep": "\n"}
    row = F.from_csv("value", ddl, opts)
    return csv_records(spark, path).select(row.alias("row")).select("row.*")
