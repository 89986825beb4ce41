"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary
(plus single characters outside it). A word's probability in a language is the
sum over all ways to cut it into pieces, computed by the forward algorithm; a
text's log-probability is the sum over its words, and the prediction is the
most probable language under equal priors.

Fitting: one distributed pass over all training rows counts the pieces of the
vocabulary's own segmentation by language (partial counts per batch, at most
one row per language and piece leaves a batch). The model is languages x
vocabulary floats, bounded by the vocabulary and the number of languages,
never by the corpus.

Scoring: one pass of Arrow batches without a shuffle. The forward scores of a
word are computed for all languages at once and kept in a bounded table.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is everything when no language was learned; a tie goes to the first
language in code-point order; repeated rows are judged each on its own; rows
with a null language are not learned from; of a document only the text is an
input of its prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
#: Smoothing count of every piece, and the share given to characters outside the vocabulary.
ALPHA, OUTSIDE = 0.1, 1e-4
#: Characters of new words worked through at a time (a longer word is worked through whole).
SLICE = 1 << 18
#: Words kept per task; the table is emptied when full.
MAX_CACHED = 400_000
UND = "und"


@lru_cache(maxsize=2)
def load(model: bytes):
    """(processor, {piece: id}, longest piece) of a vocabulary file's bytes."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sp, pieces, max(map(len, pieces))


def lattice_word(token: str) -> str:
    """A lower-cased token as it enters the lattice: letters only, marked start; else empty."""
    letters = token if token.isalpha() else "".join(filter(str.isalpha, token))
    return "▁" + letters if letters else ""


class PieceTrie:
    """The vocabulary as a trie whose steps are sorted (node, character) keys: all spans of all words at once."""

    def __init__(self, pieces: dict[str, int]):
        step: dict[tuple[int, int], int] = {}
        piece = [-1]
        for text, i in pieces.items():
            node = 0
            for c in map(ord, text):
                nxt = step.get((node, c))
                if nxt is None:
                    nxt = step[node, c] = len(piece)
                    piece.append(-1)
                node = nxt
            piece[node] = i
        keys = np.array([(n << 21) | c for n, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.piece = np.array(piece, np.int64)

    def spans(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece that lies in a word; ``left``: characters to the word's end."""
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        size = 0
        while len(at):
            key = (node << 21) | chars[at + size]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[place] == key
            at, node = at[on], self.nodes[place[on]]
            size += 1
            is_piece = self.piece[node] >= 0
            found.append((at[is_piece], at[is_piece] + size, self.piece[node[is_piece]]))
            more = left[at] > size
            at, node = at[more], node[more]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(maxsize=2)
def trie_of(model: bytes) -> PieceTrie:
    return PieceTrie(load(model)[1])


def forward(words: list[str], trie: PieceTrie, prob: np.ndarray, outside: float) -> np.ndarray:
    """Natural-log probability of each word by language, summed over all segmentations.

    ``prob`` is (vocabulary, languages); a character that is no piece itself may
    also stand alone with probability ``outside``. All words are worked through
    together, one step per position in a word, in logarithms, so that no word is
    too long or too improbable to tell languages apart.
    """
    out = np.zeros((len(words), prob.shape[1]))
    log = np.concatenate([np.log(prob), np.full((1, prob.shape[1]), np.log(outside))])
    lo = 0
    while lo < len(words):
        hi, size = lo, 0
        while hi < len(words) and (hi == lo or size + len(words[hi]) <= SLICE):
            size += len(words[hi])
            hi += 1
        out[lo:hi] = _forward_slice(words[lo:hi], trie, log)
        lo = hi
    return out


def _forward_slice(words: list[str], trie: PieceTrie, log: np.ndarray) -> np.ndarray:
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(begin, sizes)
    start, end, piece = trie.spans(chars, np.repeat(sizes, sizes) - place)
    alone = np.ones(len(chars), bool)
    alone[start[end - start == 1]] = False
    lone = np.flatnonzero(alone)
    start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
    piece = np.concatenate([piece, np.full(len(lone), len(log) - 1)])
    # a node per character and one before each word; spans in order of where they end inside their word
    node_from = start + np.searchsorted(begin, start, "right") - 1
    node_to = node_from + (end - start)
    depth = place[end - 1] + 1
    order = np.lexsort((node_to, depth))
    node_from, node_to, depth, piece = node_from[order], node_to[order], depth[order], piece[order]
    total = np.zeros((len(chars) + len(words), log.shape[1]))
    steps = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
    for a, b in zip(steps, steps[1:], strict=False):
        v = total[node_from[a:b]] + log[piece[a:b]]
        cut = np.flatnonzero(np.append(True, node_to[a + 1:b] != node_to[a:b - 1]))
        top = np.maximum.reduceat(v, cut)
        count = np.diff(np.append(cut, b - a))
        if count.max() > 1:
            top = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count, axis=0)), cut))
        total[node_to[a:b][cut]] = top
    return total[begin + np.arange(len(words)) + sizes]


def piece_counts(training: DataFrame, model: bytes) -> DataFrame:
    """Rows of (text, lang) -> lang, piece, n over the vocabulary's own segmentation."""
    import pyarrow as pa
    shared = training.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, pieces, _ = load(shared.value)
        cache: dict[str, list[int]] = {}
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(text.lower().split())
            rows: list[tuple[str, int, int]] = []
            for lang, words in found.items():
                n: Counter = Counter()
                for w, c in words.items():
                    ids = cache.get(w)
                    if ids is None:
                        if len(cache) > MAX_CACHED:
                            cache.clear()
                        ids = cache[w] = [pieces[p] for p in sp.encode(lattice_word(w)[1:], out_type=str)
                                          if p in pieces]
                    for i in ids:
                        n[i] += c
                rows += [(lang, i, c) for i, c in n.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64())], ["lang", "piece", "n"])

    part = training.select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, piece int, n long")
    return part.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(training: DataFrame, model: bytes, alpha: float = ALPHA) -> tuple[list[str], np.ndarray]:
    """(languages in code-point order, float64 (vocabulary, languages) probabilities)."""
    usable = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = piece_counts(usable, model).toPandas()  # at most languages x vocabulary rows
    langs = sorted(set(rows["lang"]), key=lambda s: s.encode())
    size = load(model)[0].get_piece_size()
    counts = np.zeros((size, len(langs)))
    col = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[rows["piece"].to_numpy(), rows["lang"].map(col).to_numpy()] = rows["n"].to_numpy()
    counts += alpha
    return langs, counts / counts.sum(0) * (1 - OUTSIDE) if langs else counts


class _WordScores:
    """Forward scores by token in a growing table; row 0 is for tokens without a letter."""

    def __init__(self, model: bytes, prob: np.ndarray):
        self.trie, self.prob, self.row, self.table = trie_of(model), prob, {}, np.zeros((1, prob.shape[1]))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log-probability by language of each text, None without a letter."""
        if len(self.row) > MAX_CACHED:
            self.row, self.table = {}, self.table[:1]
        split = [t.lower().split() if t else [] for t in texts]
        new = list({w for words in split for w in words}.difference(self.row))
        lattice = [lattice_word(w) for w in new]
        some = [k for k, w in enumerate(lattice) if w]
        scores = forward([lattice[k] for k in some], self.trie, self.prob, OUTSIDE / 1000)
        self.row.update(dict.fromkeys(new, 0))
        self.row.update(zip((new[k] for k in some), range(len(self.table), len(self.table) + len(some)), strict=True))
        self.table = np.concatenate([self.table, scores])
        rows = [np.fromiter(map(self.row.__getitem__, words), np.int64, len(words)) for words in split]
        return [self.table[r].sum(0) if r.any() else None for r in rows]


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, model: bytes) -> DataFrame:
    """``docs`` (without text) plus lang_pred and score, the posterior of the prediction."""
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast((model, langs, prob.astype(np.float32)))
    keep = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, langs_, p = shared.value
        scores_of = _WordScores(model_, p.astype(np.float64))
        for batch in batches:
            names, scores = [], []
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            totals = [t for lo in range(0, len(texts), 1024) for t in scores_of.texts(texts[lo:lo + 1024])]
            for total in totals:
                if total is None or not langs_:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                names.append(langs_[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(scan, f"{fields}, lang_pred string, score double")


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def identify_languages(docs: DataFrame, vocabulary_path: str, alpha: float = ALPHA) -> DataFrame:
    """Rows of (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    with open(vocabulary_path, "rb") as f:
        model = f.read()
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    langs, prob = fit(marked.filter(~F.col("held_out")).select("text", "lang"), model, alpha)
    return predict(marked.select("doc_id", "held_out", "text"), langs, prob, model)
