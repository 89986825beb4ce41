"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Nodes: the turns are put in order by one range-partitioned sort, so a long
conversation lies over many tasks; a running polynomial hash (two 64-bit lanes,
wrapping) over the turns of a conversation names every prefix. A node is a
distinct prefix. Texts never move: a turn travels as an MD5 of its role and
text and its length in bytes.

Totals: the tree is contracted in join rounds. A round rakes the leaves (each
adds its total to its parent) and compresses the unary chains: every node with
one child jumps to the end of its chain, in steps that triple the reach, and is
taken out with the sum that lies between; the end hangs on the chain's parent
with that sum as the weight of its edge. After a round every inner node has two
children or more, so the rounds are logarithmic in the nodes, however long the
chains. Re-expansion goes through the rounds backwards: a node that was taken
out has its sum plus the total of its chain's end, found by one join a round.

Every step is a join or a partial aggregate on node names, and is written to the
shared checkpoint folder; a node with a third of all conversations as members or
children costs each task one partial row.

Defined results: rows without conv_id take no part; null roles and texts are
empty; turns of a conversation are ordered by turn (null first), and turns of
one number by the MD5 of role and text; a repeated row is a turn of its own. An
empty table gives no rows; else the root is there, with the conversations
without turns as its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Turns that a rebuilt conversation takes of another at most (the greatest remainder of SHARE).
SHARE = 9
FAMILY = 5
#: Bytes of joined ids that travel as one row.
CHUNK = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WORD = (1 << 64) - 1
NODE = ["a", "b"]
PARENT = ["pa", "pb"]


def _powers(lane: int, exponent: np.ndarray) -> np.ndarray:
    """The lane's base to each power, by squaring; negative powers by the inverse of the odd base."""
    out = np.ones(len(exponent), np.uint64)
    for sign, base in ((1, _BASES[lane]), (-1, pow(_BASES[lane], -1, 1 << 64))):
        left = np.maximum(exponent * sign, 0).astype(np.uint64)
        while left.any():
            out = np.where(left & np.uint64(1), out * np.uint64(base), out)
            base = base * base & _WORD
            left = left >> np.uint64(1)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def turn_key(role: Column, text: Column) -> Column:
    """MD5 of a turn; the length of the role keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def _starts(conv: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if len(conv) else np.zeros(0, np.int64)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h0, h1, g0, g1, bytes): running hash of each turn's prefix and of the one before.

    ``turns`` (conv_id, turn, key, bytes) are sorted over range partitions; what a conversation's earlier
    partitions hold reaches the later ones as one small row a partition.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    lying = cut_lineage(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                        .select("conv_id", F.unhex("key").alias("key"), "bytes"))

    def own_sums(batch: pa.RecordBatch, pos: np.ndarray) -> list[np.ndarray]:
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        return [keys[:, lane] * _powers(lane, pos) for lane in (0, 1)]

    def walk(batches: Iterator[pa.RecordBatch], conv=None, pos: int = 0, sums=(0, 0)):
        """Yields (batch, positions, sums before and with each turn), starting in the middle of ``conv``."""
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("conv_id").to_numpy()
            start = _starts(ids)
            size = np.diff(np.append(start, len(ids)))
            first = np.zeros(len(start), np.int64)
            goes_on = conv is not None and ids[0] == conv
            if goes_on:
                first[0] = pos
            place = np.arange(len(ids)) - np.repeat(start, size) + np.repeat(first, size) + 1
            before, after = [], []
            for lane, value in enumerate(own_sums(batch, place)):
                run = np.cumsum(value, dtype=np.uint64)
                base = (run - value)[start]
                if goes_on:
                    base[0] = base[0] - np.uint64(sums[lane])
                after.append(run - np.repeat(base, size))
                before.append(after[-1] - value)
            conv, pos, sums = ids[-1], int(place[-1]), tuple(int(a[-1]) for a in after)
            yield batch, ids, place, before, after

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for _, ids, place, _, after in walk(batches):
            first = ids[0] if first is None else first
            last = (int(ids[-1]), int(place[-1]), *(int(a[-1]) for a in after))
        if last:
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "first": int(first), "last": last[0], "n": last[1],
                  "s0": last[2].to_bytes(8, "big"), "s1": last[3].to_bytes(8, "big")}])

    parts = sorted(lying.mapInArrow(summary, "part long, first long, last long, n long, s0 binary, s1 binary").collect())
    begin, conv, pos, sums = {}, None, 0, (0, 0)
    for r in parts:  # what has come of the conversation in whose middle a partition begins
        begin[r.part] = (conv, pos, sums)
        s = [int.from_bytes(x, "big") for x in (r.s0, r.s1)]
        if conv == r.first == r.last:  # one conversation fills the partition: its sums lie pos turns further on
            sums = tuple(((t + x * pow(b, pos, 1 << 64)) & _WORD) for t, x, b in zip(sums, s, _BASES, strict=True))
            pos += r.n
        else:
            conv, pos, sums = r.last, r.n, tuple(s)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, place, before, after in walk(batches, *begin.get(TaskContext.get().partitionId(), ())):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(place), *[pa.array(x.view(np.int64)) for x in (*after, *before)],
                 batch.column("bytes")], ["conv_id", "pos", "h0", "h1", "g0", "g1", "bytes"])

    return lying.mapInArrow(name, "conv_id long, pos long, h0 long, h1 long, g0 long, g1 long, bytes long")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the first ``h`` named behind the ``b`` turns of the other conversation."""
    for r in batches:
        h, b, pos = (r.column(c).to_numpy() for c in ("h", "b", "pos"))
        out = []
        for lane in (0, 1):
            head, cut = _unsigned(r.column(f"b{lane}")), _unsigned(r.column(f"c{lane}"))
            factor = _powers(lane, b - h)
            out += [(head + factor * (_unsigned(r.column(f"{x}{lane}")) - cut)).view(np.int64) for x in "hg"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (out[0], out[2], out[1], out[3], b + pos - h)] +
            [r.column("conv_id"), r.column("bytes")], ["a", "b", "pa", "pb", "depth", "conv_id", "bytes"])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations as node names, conversations with the node they end in)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"))
    named = cut_lineage(prefix_hashes(turns))
    # the first turns of every conversation: SHARE - 1 of them at most
    heads = (named.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < SHARE, F.struct("pos", "h0", "h1", "g0", "g1", "bytes"))))
        .alias("head")))
    families = heads.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARE
    plan = (heads.withColumns({"h": share, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
            .join(families, "base", "left")
            .withColumn("base_head", F.coalesce(F.slice("base_head", F.lit(1), F.col("h").cast("int")),
                                                F.slice("head", 1, 0)))
            .withColumn("b", F.size("base_head").cast("long")))

    def at(array: str, place: Column, field: str) -> Column:
        return F.when(place > 0, F.get(F.col(array), (place - 1).cast("int"))[field]).otherwise(F.lit(0).cast("long"))

    cut = F.least("h", "n")
    plan = cut_lineage(plan.select(
        "conv_id", "n", "h", "b", "base_head", *[at("base_head", F.col("b"), f"h{i}").alias(f"b{i}") for i in (0, 1)],
        *[at("head", cut, f"h{i}").alias(f"c{i}") for i in (0, 1)]))
    node = "a long, b long, pa long, pb long, depth long, conv_id long, bytes long"
    shared = plan.select("conv_id", F.explode("base_head").alias("x")).select(
        F.col("x.h0").alias("a"), F.col("x.h1").alias("b"), F.col("x.g0").alias("pa"), F.col("x.g1").alias("pb"),
        F.col("x.pos").alias("depth"), "conv_id", "x.bytes")
    own = (named.join(plan.drop("n", "base_head"), "conv_id").filter(F.col("pos") > F.col("h"))
           .mapInArrow(_moved, node))
    turns = cut_lineage(shared.unionByName(own))
    length = F.col("b") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return turns, plan.select("conv_id", length.alias("length"))


def _joined(df: DataFrame, other: DataFrame, on: list[str], to: list[str], how: str = "left") -> DataFrame:
    """df joined with columns of another table whose node (``to``) is df's ``on``."""
    renamed = other.select(*[F.col(t).alias(f"_{t}") for t in to], *[c for c in other.columns if c not in to])
    cond = [F.col(o) == F.col(f"_{t}") for o, t in zip(on, to, strict=True)]
    return df.join(renamed, cond, how).drop(*[f"_{t}" for t in to])


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over every node's subtree: (a, b, *values).

    ``nodes`` (a, b, pa, pb, *values) form one tree; the root's parent is null. Rake and compress alternate
    until the root is left, then the rounds are expanded backwards.
    """
    zero = {f"w_{v}": F.lit(0).cast("long") for v in values}
    live = cut_lineage(nodes.select(*NODE, *PARENT, *values).withColumns(zero))
    raked, folded = [], []
    while live.filter(F.col("pa").isNotNull()).limit(1).count():
        # rake: a node that is nobody's parent is done and adds its total to its parent
        parents = live.filter(F.col("pa").isNotNull()).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("kids"))
        marked = cut_lineage(_joined(live, parents, NODE, PARENT))
        leaf = F.col("kids").isNull() & F.col("pa").isNotNull()
        done = marked.filter(leaf)
        gained = done.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("gone"),
                                           *[F.sum(F.col(v) + F.col(f"w_{v}")).alias(f"g_{v}") for v in values])
        rest = _joined(marked.filter(~leaf), gained, NODE, PARENT)
        live = cut_lineage(rest.select(
            *NODE, *PARENT, *[(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values],
            *[f"w_{v}" for v in values], (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")))
        raked.append(done.select(*NODE, *values))
        # compress: nodes with one child, the root aside, jump to the end of their chain
        one = (F.col("kids") == 1) & F.col("pa").isNotNull()
        only = live.filter(F.col("pa").isNotNull()).select(
            *PARENT, F.col("a").alias("ea"), F.col("b").alias("eb"), *[F.col(f"w_{v}").alias(f"e_{v}") for v in values])
        chain = cut_lineage(_joined(live.filter(one), only, NODE, PARENT, "inner").select(
            *NODE, "ea", "eb", *[(F.col(v) + F.col(f"e_{v}")).alias(f"s_{v}") for v in values]))
        if not chain.limit(1).count():
            live = live.drop("kids")
            continue
        while True:
            def jump(df: DataFrame, chain: DataFrame = chain) -> DataFrame:
                ends = chain.select(*NODE, F.col("ea").alias("na"), F.col("eb").alias("nb"),
                                    *[F.col(f"s_{v}").alias(f"n_{v}") for v in values])
                return _joined(df, ends, ["ea", "eb"], NODE).select(
                    *NODE, F.coalesce("na", "ea").alias("ea"), F.coalesce("nb", "eb").alias("eb"),
                    *[(F.col(f"s_{v}") + F.coalesce(f"n_{v}", F.lit(0))).alias(f"s_{v}") for v in values],
                    F.col("na").isNotNull().alias("moved"))
            step = cut_lineage(jump(jump(chain).drop("moved")))
            chain = step.drop("moved")
            if not step.filter("moved").limit(1).count():
                break
        # a chain's end hangs on the parent of its top, with all that lies between as the edge's weight
        inside = chain.select(*NODE, F.lit(True).alias("inside"))
        tops = _joined(_joined(live, chain, NODE, NODE, "inner"), inside, PARENT, NODE).filter(F.col("inside").isNull())
        hung = tops.select("ea", "eb", F.col("pa").alias("ta"), F.col("pb").alias("tb"),
                           *[(F.col(f"w_{v}") + F.col(f"s_{v}")).alias(f"t_{v}") for v in values])
        kept = _joined(live, inside, NODE, NODE).filter(F.col("inside").isNull())
        live = cut_lineage(_joined(kept, hung, NODE, ["ea", "eb"]).select(
            *NODE, F.coalesce("ta", "pa").alias("pa"), F.coalesce("tb", "pb").alias("pb"), *values,
            *[F.coalesce(f"t_{v}", f"w_{v}").alias(f"w_{v}") for v in values]))
        folded.append((len(raked), chain))
    known = live.select(*NODE, *values)
    upto = len(raked)
    for round_, chain in reversed(folded):
        for done in raked[round_:upto]:
            known = known.unionByName(done)
        upto = round_
        ends = _joined(chain, known, ["ea", "eb"], NODE, "inner")
        known = cut_lineage(known.unionByName(ends.select(
            *NODE, *[(F.col(f"s_{v}") + F.col(v)).alias(v) for v in values])))
    for done in raked[:upto]:
        known = known.unionByName(done)
    return known


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of every node that some end in.

    The ids of a node are joined where they lie after a range sort, so the one task that digests a node
    streams chunks of text in order and never holds them together.
    """
    order = [*NODE, "conv_id"]

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in order), strict=True):
                if node != (a, b) or size > CHUNK:
                    if node:
                        out.append({"a": node[0], "b": node[1], "first": first, "ids": ",".join(ids)})
                    node, first, ids, size = (a, b), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"a": node[0], "b": node[1], "first": first, "ids": ",".join(ids)}],
                                             schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids")), strict=True):
                if node == (a, b):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append({"a": node[0], "b": node[1], "ends_sha256": state.hexdigest()})
                node, state = (a, b), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"a": node[0], "b": node[1], "ends_sha256": state.hexdigest()}], schema)

    chunks = (ends.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(join_ids, "a long, b long, first long, ids string"))
    return (chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(digest, "a long, b long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with the totals of its subtree."""
    turns, lengths = rebuilt_turns(conversations)
    inner = turns.groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = (lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
            .filter("n_convs > 0").select(zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"),
                                          zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes")))
    nodes = inner.unionByName(root)
    kids = nodes.filter(F.col("pa").isNotNull()).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(_joined(nodes, kids, NODE, PARENT).withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(*NODE, *PARENT, (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_sums(own, ["n_leaves", "saved_tokens"])
    last = (turns.select(*NODE, "depth", "conv_id").join(lengths, "conv_id").filter(F.col("depth") == F.col("length"))
            .select(*NODE, "conv_id")
            .unionByName(lengths.filter("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")))
    names = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    out = _joined(_joined(_joined(nodes, totals, NODE, NODE), _digests(last), NODE, NODE), names, PARENT, NODE)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
