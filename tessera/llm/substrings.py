"""Removal of long byte strings that occur more than once, by sparse suffix arrays.

Which suffixes are indexed: every window of ``length`` bytes names one of its
first ``SPREAD`` positions as its anchor, the one with the least hash of
``GRAM`` bytes (the leftmost of equals). The choice depends on the window's
bytes alone, so equal windows anywhere name the same place in themselves, and
about one position in 64 is an anchor. The consecutive windows that share an
anchor are its zone; all of them contain the anchor's core, the bytes from the
anchor that the first of them still reaches.

The index family: the anchors' suffixes are dealt over shards by the
fingerprint of their core. A shard receives them batch by batch; each batch is
sorted (its sparse suffix array, in fingerprint order, where suffixes with an
equal long prefix are neighbours), the levels of equal size merge
geometrically, and each batch is merge-scanned against the levels. A zone whose
core occurs once is unique; one whose whole stretch of bytes occurs twice or
more is repeated throughout; a core that is shared by differing stretches is
where matches end, and only there single windows are compared, in a second
round, by their own fingerprints. The result is exact for every byte.

Data flow: documents are packed into segments of about ``SEGMENT_BYTES`` (a
longer document is one segment of its own, worked through in slices). Only
fingerprints are shuffled between shards, once per segment and distinct value,
so a string that a third of all rows share costs each shard one entry per
segment; the texts move once, to meet the verdicts on their segment.

With ``passage``, shorter strings are searched for by the same two rounds, and
the long ones only inside what these leave: every part of a string that occurs
twice occurs twice, so no long one lies elsewhere. Entries of the long search
go to shards of their own, numbered after the others.

Defined results: a null text is empty; texts shorter than ``length`` keep all
bytes; repeated rows are copies of one another and lose all their windows; an
empty table gives no rows; all other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shuffle_width

LENGTH = 400
#: A passage repeats and holds over 50 words; the byte length that is searched for lies far below
#: 51 words of running text, and a repeated run of 400 bytes counts whatever its words (scripts without spaces).
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51
GRAM = 16
SPREAD = 128
SEGMENT_BYTES = 1 << 20
SLICE = 1 << 20
#: Suffixes gathered before a shard's family takes them in as one batch.
BATCH = 1 << 15
NONE, WHOLE, ASK, WHOLE_SHOWN = 0, 1, 2, 3
#: Bytes between words.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and the powers of the hash base and of its inverse."""
    letters = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    power = np.full(n, _BASE, np.uint64)
    inverse = np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return letters, np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


class Slice:
    """Hashes of all substrings of up to ``SLICE`` windows' worth of bytes."""

    def __init__(self, data: np.ndarray, length: int):
        letters, power, self.inverse = _tables(SLICE + 2 * length + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * power[:len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def zones(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[Slice, int, dict[str, np.ndarray]]]:
    """(hashes, offset, zones) by slice: first and last window, core and stretch fingerprints."""
    spread = max(1, min(SPREAD, length - GRAM))
    core = length - spread + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(starts, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    fits = np.cumsum(edge[:-1]) == 0  # a window starting here ends inside its document
    bits, steps = np.uint64(24), int(np.log2(spread))
    place = np.uint64((1 << 24) - 1)
    for at in range(0, len(data), SLICE):
        p = np.flatnonzero(fits[at:at + SLICE])
        if not len(p):
            continue
        part = data[at:at + SLICE + length - 1]
        h = Slice(part, length)
        n = len(part) - GRAM + 1
        grams = np.arange(n)
        v = (h.hash(grams, grams + GRAM) >> bits << bits) | grams.astype(np.uint64)
        least = v
        for k in range(steps):
            least = np.minimum(least[:-(1 << k)], least[1 << k:])
        left = spread - (1 << steps)
        if left:
            least = np.minimum(least[:-left], least[left:])
        anchor = (least[p] & place).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
        first, last, s = p[new], p[np.append(new[1:], len(p)) - 1], anchor[new]
        shape = _mix(((last - first).astype(np.uint64) << np.uint64(32)) | (s - first).astype(np.uint64))
        yield h, at, {"first": first, "last": last, "core": h.hash(s, s + core),
                      "stretch": _mix(h.hash(first, last + length) ^ shape)}


def _distinct(core: np.ndarray, stretch: np.ndarray, shards: int):
    """Distinct (core, stretch) sorted by shard and value: values, whether several, place of each input."""
    shard = (core % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((stretch, core, shard))
    c, s = core[order], stretch[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    several = np.bincount(place, minlength=int(new.sum())) > 1
    return c[new], s[new], several, shard[order][new], place


def _pair(core: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    return _mix(core * _BASE ^ stretch)


class LevelFamily:
    """Levels of sorted suffix entries; equal-sized levels merge as batches come.

    A level is two sorted runs: the cores with their least and greatest
    stretch, and the (core, stretch) pairs with their count up to 2.
    """

    def __init__(self):
        self.levels: list[tuple[int, tuple, tuple]] = []

    @staticmethod
    def _cores(core, low, high):
        order = np.argsort(core, kind="stable")
        cut = np.flatnonzero(np.diff(core[order], prepend=~core[order[:1]]) != 0)
        return core[order][cut], np.minimum.reduceat(low[order], cut), np.maximum.reduceat(high[order], cut)

    @staticmethod
    def _pairs(pair, count):
        order = np.argsort(pair, kind="stable")
        cut = np.flatnonzero(np.diff(pair[order], prepend=~pair[order[:1]]) != 0)
        return pair[order][cut], np.minimum(np.add.reduceat(count[order], cut), 2)

    def insert(self, core: np.ndarray, stretch: np.ndarray, count: np.ndarray) -> None:
        if not len(core):
            return
        level, cores, pairs = 0, self._cores(core, stretch, stretch), self._pairs(_pair(core, stretch), count)
        while self.levels and self.levels[-1][0] == level:
            _, old_cores, old_pairs = self.levels.pop()
            cores = self._cores(*map(np.concatenate, zip(old_cores, cores, strict=True)))
            pairs = self._pairs(*map(np.concatenate, zip(old_pairs, pairs, strict=True)))
            level += 1
        self.levels.append((level, cores, pairs))

    def scan(self, core: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By entry: whether its core also has another stretch, and how often its own occurs (up to 2)."""
        other, own, pair = np.zeros(len(core), bool), np.zeros(len(core), np.int64), _pair(core, stretch)
        for _, (c, low, high), (p, n) in self.levels:
            at = np.minimum(np.searchsorted(c, core), len(c) - 1)
            other |= (c[at] == core) & ((low[at] != stretch) | (high[at] != stretch))
            at = np.minimum(np.searchsorted(p, pair), len(p) - 1)
            own += np.where(p[at] == pair, n[at], 0)
        return other, np.minimum(own, 2)


def _judge_shard(group):
    """One shard: verdicts on the zones of each segment, in the order they came."""
    import pyarrow as pa
    rows = sorted(group.to_pylist(), key=lambda r: r["seg"])
    core = [np.frombuffer(r["a"], np.uint64) for r in rows]
    stretch = [np.frombuffer(r["b"], np.uint64) for r in rows]
    count = [np.frombuffer(r["n"], np.uint8).astype(np.int64) + 1 for r in rows]
    family, size, held = LevelFamily(), 0, 0
    for i in range(len(rows)):
        size += len(core[i])
        if size >= BATCH or i == len(rows) - 1:
            family.insert(*(np.concatenate(x[held:i + 1]) for x in (core, stretch, count)))
            size, held = 0, i + 1
    shown: set[tuple[int, int]] = set()
    out = []
    for r, c, s in zip(rows, core, stretch, strict=True):
        other, own = family.scan(c, s)
        verdict = np.where(own >= 2, WHOLE, np.where(other, ASK, NONE)).astype(np.uint8)
        for i in np.flatnonzero((own >= 2) & other).tolist():
            key = (int(c[i]), int(s[i]))
            if key not in shown:
                shown.add(key)
                verdict[i] = WHOLE_SHOWN
        out.append({"seg": r["seg"], "shard": r["shard"], "round": 1, "v": verdict.tobytes()})
    return pa.Table.from_pylist(out, pa.schema([("seg", pa.int64()), ("shard", pa.int32()), ("round", pa.int32()),
                                                ("v", pa.binary())]))


def _judge_windows(group):
    """One shard of window fingerprints: which occur twice or more."""
    import pyarrow as pa
    rows = group.to_pylist()
    value = [np.frombuffer(r["a"], np.uint64) for r in rows]
    if not rows:
        return pa.Table.from_pylist([], pa.schema([("seg", pa.int64()), ("shard", pa.int32()),
                                                   ("round", pa.int32()), ("v", pa.binary())]))
    every = np.concatenate(value)
    several = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64) + 1
    _, place = np.unique(every, return_inverse=True)
    twice = (np.bincount(place, weights=several) >= 2)[place].astype(np.uint8)
    cut = np.split(twice, np.cumsum([len(v) for v in value])[:-1])
    out = [{"seg": r["seg"], "shard": r["shard"], "round": 2, "v": v.tobytes()}
           for r, v in zip(rows, cut, strict=True)]
    return pa.Table.from_pylist(out, pa.schema([("seg", pa.int64()), ("shard", pa.int32()), ("round", pa.int32()),
                                                ("v", pa.binary())]))


def _judge(group):
    """One shard of zones or, where entries have no stretch, of window fingerprints."""
    return _judge_windows(group) if group.column("b").null_count else _judge_shard(group)


ENTRY = "shard int, seg long, a binary, b binary, n binary"
VERDICT = "seg long, shard int, round int, v binary"


def _entries(seg: int, a, b, several, shard) -> list[dict]:
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    out = []
    for lo, hi in zip(cut, np.append(cut[1:], len(shard)), strict=True):
        out.append({"shard": int(shard[lo]), "seg": seg, "a": a[lo:hi].tobytes(),
                    "b": b[lo:hi].tobytes() if b is not None else None, "n": several[lo:hi].tobytes()})
    return out


def _segment_zones(data: bytes, ends: bytes, length: int):
    """All zones of a segment: (slices, offsets, arrays, slice number of each zone)."""
    found = list(zones(np.frombuffer(data, np.uint8), np.frombuffer(ends, np.int64), length))
    if not found:
        empty = {k: np.zeros(0, np.uint64 if k in ("core", "stretch") else np.int64)
                 for k in ("first", "last", "core", "stretch")}
        return [], [], empty, np.zeros(0, np.int64)
    arrays = {k: np.concatenate([z[k] for _, _, z in found]) for k in found[0][2]}
    which = np.repeat(np.arange(len(found)), [len(z["first"]) for _, _, z in found])
    return [h for h, _, _ in found], [at for _, at, _ in found], arrays, which


def _zone_verdicts(zone: dict, shards: int, answers: list[dict]) -> np.ndarray:
    _, _, _, shard, place = _distinct(zone["core"], zone["stretch"], shards)
    v = _ordered(answers, 1)
    return v[place] if len(place) else np.zeros(0, np.uint8)


def _ordered(answers: list[dict], round_: int) -> np.ndarray:
    own = sorted((r for r in answers if r["round"] == round_), key=lambda r: r["shard"])
    return np.concatenate([np.frombuffer(r["v"], np.uint8) for r in own]) if own else np.zeros(0, np.uint8)


def _open_windows(zone, which, slices, offsets, verdict, length, shards):
    """Windows to compare singly: positions, sorted distinct fingerprints, several, shard, place."""
    pick = np.flatnonzero((verdict == ASK) | (verdict == WHOLE_SHOWN))
    n = zone["last"][pick] - zone["first"][pick] + 1
    local = np.repeat(zone["first"][pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(which[pick], n)
    value = np.zeros(len(local), np.uint64)
    at = np.zeros(len(local), np.int64)
    for i, (h, off) in enumerate(zip(slices, offsets, strict=True)):
        m = owner == i
        value[m] = h.hash(local[m], local[m] + length)
        at[m] = local[m] + off
    v, _, several, shard, place = _distinct(value, np.zeros_like(value), shards)
    return at, v, several, shard, place


def _cover(size: int, zone, which, offsets, pick, single, length: int) -> np.ndarray:
    """Bytes covered by the windows of picked zones or by single windows."""
    edge = np.zeros(size + 1, np.int32)
    base = np.array(offsets, np.int64)[which[pick]] if len(which) else np.zeros(0, np.int64)
    np.add.at(edge, zone["first"][pick] + base, 1)
    np.add.at(edge, zone["last"][pick] + base + length, -1)
    np.add.at(edge, single, 1)
    np.add.at(edge, single + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated(data: bytes, ends: bytes, length: int, shards: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings that occur twice; bytes that the first round left possible."""
    slices, offsets, z, which = _segment_zones(data, ends, length)
    verdict = _zone_verdicts(z, shards, answers)
    at, _, _, _, place = _open_windows(z, which, slices, offsets, verdict, length, shards)
    single = at[_ordered(answers, 2)[place] == 1] if len(at) else at
    whole = (verdict == WHOLE) | (verdict == WHOLE_SHOWN)
    none = np.zeros(0, np.int64)
    return (_cover(len(data), z, which, offsets, whole, single, length),
            _cover(len(data), z, which, offsets, verdict != NONE, none, length))


def long_stretches(data: bytes, ends: bytes, maybe: np.ndarray, length: int) -> tuple[np.ndarray, bytes, bytes]:
    """Runs of ``maybe`` of at least ``length`` bytes, each inside one document: starts, bytes, ends as of a segment."""
    step = np.diff(maybe.astype(np.int8), prepend=0, append=0)
    border = np.unique(np.frombuffer(ends, np.int64))
    border = border[(border > 0) & (border < len(data))]
    border = border[maybe[border - 1] & maybe[border]]
    start = np.sort(np.concatenate([np.flatnonzero(step == 1), border]))
    stop = np.sort(np.concatenate([np.flatnonzero(step == -1), border]))
    long = stop - start >= length
    start, stop = start[long], stop[long]
    return (start, b"".join(data[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)),
            np.cumsum(stop - start, dtype=np.int64).tobytes())


def _columns(docs: DataFrame) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != "text"])


def pack_segments(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Documents packed in scan order: seg, keep (the other columns), data (all texts), ends."""
    import pyarrow as pa
    others = _columns(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = size = 0
            for i in range(len(texts) + 1):
                n = len(texts[i] or b"") if i < len(texts) else 0
                if i == len(texts) or (i > lo and size + n > segment_bytes):
                    if i > lo:
                        own = [t or b"" for t in texts[lo:i]]
                        keep = pa.ListArray.from_arrays(pa.array([0, i - lo], pa.int32()),
                                                        pa.concat_arrays([batch.column(0).slice(lo, i - lo)]))
                        ends = np.cumsum([len(t) for t in own], dtype=np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([(part << 33) + made]), keep, pa.array([b"".join(own)], pa.binary()),
                             pa.array([ends.tobytes()], pa.binary())], ["seg", "keep", "data", "ends"])
                        made += 1
                    lo, size = i, 0
                size += n

    schema = T.StructType([T.StructField("seg", T.LongType()), T.StructField("keep", T.ArrayType(others)),
                           T.StructField("data", T.BinaryType()), T.StructField("ends", T.BinaryType())])
    rows = docs.select(F.struct(*[docs[c] for c in others.names]).alias("keep"), docs["text"].cast("binary"))
    return rows.mapInArrow(pack, schema)


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` widened to all bytes of every UTF-8 character that it touches."""
    first = (text & 0xC0) != 0x80
    first[:1] = True
    at = np.flatnonzero(first)
    return np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(text)))) if len(at) else gone


def long_passages(data: np.ndarray, gone: np.ndarray, words: int) -> np.ndarray:
    """``gone`` without its runs that hold fewer than ``words`` whole words and are shorter than ``LENGTH`` bytes.

    Of a run with whole words just these go, so that what stands around it stays whole words too.
    """
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letter = np.diff(~_BLANK[data], prepend=False, append=False)
    first, last = np.flatnonzero(letter)[::2], np.flatnonzero(letter)[1::2]
    whole = np.searchsorted(last, stop, "right") - np.searchsorted(first, start, "left")
    keep = (whole >= words) | (stop - start >= LENGTH)
    some = np.flatnonzero(whole > 0)
    start[some] = first[np.searchsorted(first, start[some])]
    stop[some] = last[np.searchsorted(last, stop[some], "right") - 1]
    out = np.zeros(len(gone) + 1, np.int8)
    out[start[keep]], out[stop[keep]] = 1, -1
    return np.cumsum(out[:-1], dtype=np.int8).astype(bool)


def remove_repeats(docs: DataFrame, length: int = LENGTH, segment_bytes: int = SEGMENT_BYTES,
                   characters: bool = False, words: int = 0, passage: tuple[int, int] | None = None) -> DataFrame:
    """Every row of ``docs`` without ``text`` plus kept (bytes left), n_bytes, n_removed, n_spans, kept_sha256.

    With ``words``, a run of repeated bytes goes only if it holds that many whole words or ``LENGTH`` bytes;
    parts of words at its ends stay.

    With ``characters``, kept (and its hash) also lacks the rest of a character cut in half; the counts stay.

    With ``passage``, a byte length of at most ``length`` and a number of words, n_passage_bytes follows: the bytes
    that ``words`` would take at that length. Nothing else depends on it.
    """
    import pyarrow as pa
    if passage and passage[0] > length:
        raise ValueError("a passage is searched for by strings no longer than those removed")
    short = passage[0] if passage else length
    shards = 2 * shuffle_width(docs.sparkSession)
    segments = pack_segments(docs, segment_bytes).repartition("seg")
    entry = pa.schema([("shard", pa.int32()), ("seg", pa.int64()), ("a", pa.binary()), ("b", pa.binary()),
                       ("n", pa.binary())])

    def zone_entries(seg: int, z: dict, first_shard: int = 0) -> list[dict]:
        c, s, several, shard, _ = _distinct(z["core"], z["stretch"], shards)
        return _entries(seg, c, s, several, shard + first_shard) if len(c) else []

    def window_entries(seg: int, found: tuple, verdict: np.ndarray, size: int, first_shard: int = 0) -> list[dict]:
        slices, offsets, z, which = found
        _, v, several, shard, _ = _open_windows(z, which, slices, offsets, verdict, size, shards)
        return _entries(seg, v, None, several, shard + first_shard) if len(v) else []

    def by_search(answers: pa.Table) -> tuple[list[dict], list[dict]]:
        rows = answers.to_pylist()
        return [r for r in rows if r["shard"] < shards], [r for r in rows if r["shard"] >= shards]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["seg", "data", "ends"]).to_pylist():
                out = zone_entries(r["seg"], _segment_zones(r["data"], r["ends"], short)[2])
                if out:
                    yield pa.RecordBatch.from_pylist(out, entry)

    def stretches(r: dict, found: tuple, verdict: np.ndarray) -> tuple[bytes, bytes]:
        _, offsets, z, which = found
        maybe = _cover(len(r["data"]), z, which, offsets, verdict != NONE, np.zeros(0, np.int64), short)
        return long_stretches(r["data"], r["ends"], maybe, length)[1:]

    def open_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], right.to_pylist()
        for r in left.select(["seg", "data", "ends"]).to_pylist():
            found = _segment_zones(r["data"], r["ends"], short)
            verdict = _zone_verdicts(found[2], shards, answers)
            out += window_entries(r["seg"], found, verdict, short)
            if passage:
                out += zone_entries(r["seg"], _segment_zones(*stretches(r, found, verdict), length)[2], shards)
        return pa.Table.from_pylist(out, entry)

    def open_long(left: pa.Table, right: pa.Table) -> pa.Table:
        out, (answers, long_answers) = [], by_search(right)
        for r in left.select(["seg", "data", "ends"]).to_pylist():
            found = _segment_zones(r["data"], r["ends"], short)
            inner = _segment_zones(*stretches(r, found, _zone_verdicts(found[2], shards, answers)), length)
            out += window_entries(r["seg"], inner, _zone_verdicts(inner[2], shards, long_answers), length, shards)
        return pa.Table.from_pylist(out, entry)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, (answers, long_answers) = [], by_search(right)
        for i, r in enumerate(left.select(["data", "ends"]).to_pylist()):
            data, ends = r["data"], np.frombuffer(r["ends"], np.int64)
            gone, maybe = _repeated(data, r["ends"], short, shards, answers)
            if passage:
                shared = gone
                start, *inner = long_stretches(data, r["ends"], maybe, length)
                found, _ = _repeated(*inner, length, shards, long_answers)
                gone, lo = np.zeros(len(data), bool), 0
                for a, hi in zip(start.tolist(), np.frombuffer(inner[1], np.int64).tolist(), strict=True):
                    gone[a:a + hi - lo] = found[lo:hi]
                    lo = hi
            kept, n_bytes, n_removed, n_spans, sha, n_passage = [], [], [], [], [], []
            lo = 0
            whole_data = np.frombuffer(data, np.uint8)
            for hi in ends.tolist():
                g = gone[lo:hi]
                if words and g.any():
                    g = long_passages(whole_data[lo:hi], g, words)
                removed = int(g.sum())
                rest = data[lo:hi] if not removed else whole_data[lo:hi][
                    ~(whole_characters(whole_data[lo:hi], g) if characters else g)].tobytes()
                kept.append(rest)
                n_bytes.append(hi - lo)
                n_removed.append(removed)
                n_spans.append(int((g[1:] & ~g[:-1]).sum()) + int(g[0]) if removed else 0)
                sha.append(hashlib.sha256(rest).hexdigest())
                if passage:
                    n_passage.append(int(long_passages(whole_data[lo:hi], shared[lo:hi], passage[1]).sum())
                                     if shared[lo:hi].any() else 0)
                lo = hi
            keep = left.column("keep").combine_chunks()
            tables.append(pa.Table.from_arrays(
                [keep.slice(i, 1).flatten(), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()),
                 *([pa.array(n_passage, pa.int64())] if passage else [])], names=result.names))
        return pa.concat_tables(tables) if tables else empty

    others = _columns(docs)
    result = T.StructType([T.StructField("keep", others), T.StructField("kept", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType()),
                           *([T.StructField("n_passage_bytes", T.LongType())] if passage else [])])
    from pyspark.sql.pandas.types import to_arrow_schema
    empty = to_arrow_schema(result).empty_table()
    entries = segments.mapInArrow(index, ENTRY)  # of all columns: with fewer, the texts were shuffled a second time
    first = entries.groupBy("shard").applyInArrow(_judge_shard, VERDICT)
    windows = segments.groupBy("seg").cogroup(first.groupBy("seg")).applyInArrow(open_windows, ENTRY)
    answers = first.unionByName(windows.groupBy("shard").applyInArrow(_judge, VERDICT))
    if passage:
        windows = segments.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(open_long, ENTRY)
        answers = answers.unionByName(windows.groupBy("shard").applyInArrow(_judge, VERDICT))
    return segments.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(cut, result)
