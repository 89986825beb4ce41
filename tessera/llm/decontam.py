"""Benchmark decontamination with a positional inverted index.

``build_index`` turns the documents into a positional inverted index cut into
segments of at most ``segment_words`` words (a longer document is a segment of
its own): one row per segment and term with the ascending word positions, and
one row per segment with its documents. ``search`` looks for phrases in it:
per segment the terms of a phrase are taken from the rarest up, the rarest
one's positions minus its offset in the phrase are the candidate starts, and
each further list, shifted by its offset, keeps the candidates it contains. A
``slop`` above 0 lets every term stand that many places from its offset and so
returns proximity matches. Documents are parted by a gap in the positions, so
no match crosses two of them.

The test items are the stated query set. They are read in blocks of at most
``BLOCK_BYTES`` of text, chosen by a hash of the item, and every block is
searched against all documents; a block's phrases and terms are what is
broadcast, so the broadcast is bounded whatever the number of items. Postings
are kept for a block's terms only. Segments, not terms or documents, are the
unit of the one shuffle, so a term, line or document that a third of all rows
share spreads over all segments that hold it.

Defined results: a null or wordless text has 0 words, hits nothing and is not
contaminated; a null or wordless item has no window; an item listed twice
counts once; a null item id is listed as the empty string; repeated documents
are judged each on its own; ``docs`` may have further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SEGMENT_WORDS = 400_000
BLOCK_BYTES = 16 << 20
# Fixed value: the contract's word characters (ASCII letters and digits, and all beyond ASCII); A-Z fold.
_FOLD = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
INDEX_SCHEMA = "segment long, term binary, at binary, rows binary, ends binary"


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; the whole item when it is shorter, none without words."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class _Terms(dict):
    """Term numbers; grows with the text, or answers -1 beyond a given set."""

    def __init__(self, terms: list[bytes] | None):
        super().__init__((t, i) for i, t in enumerate(terms or []))
        self.grows = terms is None

    def __missing__(self, term: bytes) -> int:
        if not self.grows:
            return -1
        self[term] = n = len(self)
        return n


def build_index(docs: DataFrame, terms: list[bytes] | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Rows of (row, text) -> the index; ``terms`` keeps the postings of these words only.

    Posting rows hold ``term`` and ``at`` (int32 positions); the one row per
    segment with a null term holds ``rows`` (int64) and ``ends`` (int64, the
    position after each document's last word).
    """
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        number = _Terms(shared.value)
        schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("at", pa.binary()),
                            ("rows", pa.binary()), ("ends", pa.binary())])
        ids: list[np.ndarray] = []
        rows: list[int] = []
        ends: list[int] = []
        at = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, rows, ends, at, made, number
            segment = (part << 33) + made
            made += 1
            tokens = np.concatenate(ids)
            order = np.argsort(tokens, kind="stable")
            ranked = tokens[order]
            first = int(np.searchsorted(ranked, 0))
            order, ranked = order[first:].astype(np.int32), ranked[first:]
            cut = np.flatnonzero(np.diff(ranked, prepend=-1))
            found = ranked[cut]
            lists = np.split(order, cut[1:]) if len(cut) else []
            names = list(number)
            out = [{"segment": segment, "term": names[t], "at": p.tobytes()}
                   for t, p in zip(found.tolist(), lists, strict=True)]
            out.append({"segment": segment, "rows": np.array(rows, np.int64).tobytes(),
                        "ends": np.array(ends, np.int64).tobytes()})
            ids, rows, ends, at = [], [], [], 0
            if number.grows:
                number = _Terms(None)
            return pa.RecordBatch.from_pylist(out, schema)

        gap = np.array([-1], np.int32)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = item_words(text)
                if rows and at + len(words) > segment_words:
                    yield flush()
                ids += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), gap]
                at += len(words)
                rows.append(row)
                ends.append(at)
                at += 1
        if rows:
            yield flush()

    return docs.select("row", F.col("text").cast("binary")).mapInArrow(scan, INDEX_SCHEMA)


def match(lists: list[np.ndarray], phrases: list[np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every match, sorted, from position lists by term and phrases of term numbers."""
    none = np.zeros(0, np.int64)
    length = np.array([len(x) for x in lists], np.int64)
    base = np.concatenate([[0], np.cumsum(length)])
    every = np.concatenate(lists).astype(np.int64) if lists else none
    span = int(every.max()) + 2 * (slop + max((len(p) for p in phrases), default=0)) + 2 if len(every) else 1
    keys = np.repeat(np.arange(len(lists), dtype=np.int64), length) * span + every  # ascending by term, position
    who, starts = [none], [none]
    for size in sorted({len(p) for p in phrases}):
        own = np.array([i for i, p in enumerate(phrases) if len(p) == size], np.int64)
        term = np.stack([phrases[i] for i in own])
        own, term = (x[(length[term] > 0).all(1)] for x in (own, term))
        rare = np.argsort(length[term], axis=1, kind="stable")
        lead = np.take_along_axis(term, rare[:, :1], 1)[:, 0] if len(own) else none
        n = length[lead]
        cand = np.repeat(np.arange(len(own)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[lead], n)
        start = every[place] - rare[cand, 0]
        keep = start >= 0
        cand, start = cand[keep], start[keep]
        for k in range(1, size):
            t, off = term[cand, rare[cand, k]], rare[cand, k]
            low = np.maximum(start + off - slop, 0)
            at = np.searchsorted(keys, t * span + low)
            near = np.take(keys, np.minimum(at, len(keys) - 1)) if len(keys) else low
            ok = (at < len(keys)) & (near <= t * span + start + off + slop) & (near >= t * span)
            cand, start = cand[ok], start[ok]
        who.append(own[cand])
        starts.append(start)
    w, s = np.concatenate(who), np.concatenate(starts)
    order = np.lexsort((s, w))
    return w[order], s[order]


def search(index: DataFrame, phrases: list[tuple[bytes, ...]], owners: list[list[str]], slop: int = 0,
           every_row: bool = True) -> DataFrame:
    """Matches of ``phrases`` (each with the ids of its items) in an index, by document row.

    -> row, n_words, hits (word positions inside any match), items (their ids).
    Documents without a match come too when ``every_row``.
    """
    import pyarrow as pa
    terms = sorted({t for p in phrases for t in p})
    number = {t: i for i, t in enumerate(terms)}
    shared = index.sparkSession.sparkContext.broadcast(
        (number, [np.array([number[t] for t in p], np.int64) for p in phrases], owners))
    schema = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())),
                        ("items", pa.list_(pa.string()))])

    def find(group: pa.Table) -> pa.Table:
        number_, phrases_, owners_ = shared.value
        lists = [np.zeros(0, np.int32)] * len(number_)
        rows = ends = np.zeros(0, np.int64)
        for r in group.select(["term", "at", "rows", "ends"]).to_pylist():
            if r["term"] is None:
                rows, ends = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ends"], np.int64)
            elif r["term"] in number_:
                lists[number_[r["term"]]] = np.frombuffer(r["at"], np.int32)
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        which, start = match(lists, phrases_, slop)
        doc = np.searchsorted(ends, start, side="right")
        size = np.array([len(p) for p in phrases_], np.int64)[which]
        out: dict[int, tuple[set, set]] = {}
        for d, s, n, w in zip(doc.tolist(), (start - begins[doc]).tolist() if len(doc) else [], size.tolist(),
                              which.tolist(), strict=True):
            hits, items = out.setdefault(d, (set(), set()))
            hits.update(range(s, s + n))
            items.update(owners_[w])
        wanted = range(len(rows)) if every_row else sorted(out)
        got = [out.get(d, ((), ())) for d in wanted]
        return pa.Table.from_arrays([
            pa.array([int(rows[d]) for d in wanted], pa.int64()),
            pa.array([int(ends[d] - begins[d]) for d in wanted], pa.int64()),
            pa.array([sorted(h) for h, _ in got], pa.list_(pa.int32())),
            pa.array([sorted(i) for _, i in got], pa.list_(pa.string()))], schema=schema)

    return index.groupBy("segment").applyInArrow(find, "row long, n_words long, hits array<int>, items array<string>")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The items' windows with the ids they occur in, a bounded block of items at a time."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
                        F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).toLocalIterator():
            for w in windows(item_words(bytes(r["text"]))):
                found.setdefault(w, set()).add(r["id"])
        yield found


def find_contamination(docs: DataFrame, items: DataFrame, slop: int = 0, block_bytes: int = BLOCK_BYTES,
                       segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Rows of (row, text), ``row`` a unique long, -> row, n_words, n_hit, items, contaminated."""
    parts = []
    for b, block in enumerate(_blocks(items, block_bytes)):
        phrases = sorted(block)
        terms = sorted({t for p in phrases for t in p})
        index = build_index(docs, terms, segment_words)
        parts.append(search(index, phrases, [sorted(block[p]) for p in phrases], slop, every_row=b == 0))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    if len(parts) > 1:
        merged = merged.groupBy("row").agg(F.max("n_words").alias("n_words"),
                                           F.flatten(F.collect_list("hits")).alias("hits"),
                                           F.flatten(F.collect_list("items")).alias("items"))
    n_hit = F.size(F.array_distinct("hits")).cast("long")
    return merged.select("row", "n_words", n_hit.alias("n_hit"), F.array_distinct("items").alias("items"),
                         ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Row numbers are those of the scan, so ``docs`` should be a table read as it lies.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = find_contamination(rows.select("row", "text"), items, **options)
    return rows.select("row", "doc_id").join(found, "row").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"), "contaminated")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows, all their columns unchanged."""
    rows = docs.select(F.struct("*").alias("doc"), "text", F.monotonically_increasing_id().alias("row"))
    bad = find_contamination(rows.select("row", "text"), items, **options).filter("contaminated").select("row")
    return rows.drop("text").join(bad, "row", "left_anti").select("doc.*")
