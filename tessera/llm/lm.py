"""Language-model scores of texts: corpus-wide word counts under causal attention.

Tokens are the lower-cased words of a text and one end. The probability of a
token is that of its leading subword id given the context times that of the
word given the id. The id is found by longest match in a fixed public
vocabulary; every id of the training tokens is an input and an outcome of its
own, and so is the end. The word's part comes from counts over every training
token; the id's part from one causal self-attention layer, trained in numpy,
whose output starts from the corpus's shares of the ids. So
``score = base_score + sum of log10 (P(id | context) / share(id))``.

The output is a factored softmax. The ids with the most training tokens have a
class each, so has the end; the others, the tail, share one class, are dealt by
frequency into about as many groups as a group has ids, and
``P(id) = P(class) P(group | tail) P(id | group)``, each factor a softmax of the
same context. A token costs the classes, and one of the tail two square roots of
it. An id that no training token has is the tail's last.

One pass over all texts counts their words and stores, for the training documents, the leading ids of all
tokens (4 bytes a token). Every training token is the target of one training window: windows of ``2 * STRIDE``
consecutive tokens, each attending causally to those before it. The documents are dealt over ``ROUNDS`` rounds
of data-parallel steps: every task runs Adam from the shared weights over its windows, and the weights are
averaged, weighted by windows, as a Spark aggregate (a row per weight reaches the driver).

Scoring: windows of ``2 * STRIDE`` tokens overlap by half; each scores its last
``STRIDE`` tokens once, attending causally to all before them in the window,
many windows in one masked batch.

Counts: the ``head`` most frequent words (a bound, not the vocabulary) go to
the tasks with the model; the other words of a text are shuffled to the count
table by a 64-bit hash and their sums come back by document, so no corpus-sized
table is ever broadcast or collected. Frequent means in all texts, held-out ones
included: a word that fills them and that no training document has is in the
head with a count of 0, and a frequent word is never shuffled by its key.

Defined results: a null text is empty, its one token is the end; without
training documents every count is 0 and the score equals the base; repeated
rows are scored each on its own; rows with a null id are trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.langid import held_out
from tessera.llm.wordhash import hash_words
from tessera.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
CLASSES, WIDTH, STRIDE = 64, 16, 16
HEAD = 200_000
ROUNDS, BATCH, RATE = 4, 32, 0.02
#: Distinct words whose counts a task holds before it sends them on.
MAX_WORDS = 1_000_000
#: Tokens of one stored run of a training document.
RUN = 1 << 16
#: Words of one stored pack, and a record of it: hash, leading id, count in training, count in all.
PACK = 1 << 16
WORD = np.dtype([("h", "<i8"), ("piece", "<i4"), ("n", "<i8"), ("m", "<i8")])
END_PIECE = -1
#: Hash of the end, a token of no letters.
END = 0


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> dict[str, int]:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


class LeadPieces:
    """The vocabulary strings that can start a word, as a byte trie: a row of 256 next nodes by node, 0 for none.

    The leading id of a word is that of the longest vocabulary string that starts it, 0 without one.
    """

    def __init__(self, model: bytes):
        step: dict[tuple[int, int], int] = {}
        mark = "▁"
        ids = pieces_of(model)
        piece = [ids.get(mark, 0)]
        for text, i in ids.items():
            if text.startswith(mark) and text != mark:
                node = 0
                for byte in text[1:].encode():
                    node = step.setdefault((node, byte), len(piece))
                    if node == len(piece):
                        piece.append(-1)
                piece[node] = i
        self.next = np.zeros(len(piece) << 8, np.int32)
        self.next[[n << 8 | c for n, c in step]] = list(step.values())
        self.piece = np.array(piece, np.int64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        best = np.full(len(start), self.piece[0])
        live, node, size = np.flatnonzero(start < end), np.zeros(int((start < end).sum()), np.int64), 0
        while len(live):
            node = self.next[node.astype(np.int64) << 8 | data[start[live] + size]]
            on = node > 0
            live, node = live[on], node[on]
            size += 1
            found = self.piece[node]
            best[live[found >= 0]] = found[found >= 0]
            more = start[live] + size < end[live]
            live, node = live[more], node[more]
        return best


@lru_cache(maxsize=2)
def lead_pieces(model: bytes) -> LeadPieces:
    return LeadPieces(model)


def distinct_tokens(texts: list[bytes | None], lead: LeadPieces):
    """Tokens of some texts: (number by text, place of each token in what follows, distinct hashes, leading ids).

    The end is a token of hash ``END`` that closes every text.
    """
    h, n, data, start, end = hash_words(texts)
    place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)
    token, word = np.full(len(h) + len(texts), END, np.int64), np.full(len(h) + len(texts), -1)
    token[place], word[place] = h.view(np.int64), np.arange(len(h))
    order = np.argsort(token)  # not stable: equal tokens are equal words, any of them will do
    token = token[order]
    new = np.ones(len(token), bool)
    np.not_equal(token[1:], token[:-1], out=new[1:])
    inverse = np.empty(len(token), np.int64)
    inverse[order] = np.cumsum(new) - 1
    distinct, word = token[new], word[order[new]]
    piece = np.full(len(distinct), END_PIECE)
    piece[word >= 0] = lead.of(np.frombuffer(data, np.uint8), start[word[word >= 0]], end[word[word >= 0]])
    return n + 1, inverse, distinct, piece


# -- the attention layer ---------------------------------------------------------------

def initial(shares: np.ndarray, width: int = WIDTH, stride: int = STRIDE, seed: int = 7,
            tail: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights of the layer; ``tail`` has the shares of the ids in the last class but one, if they are told apart.

    ``T`` is added to that class's input, ``G`` and ``g`` give the groups of the tail, ``S`` and ``s`` the ids of each.
    """
    rng = np.random.default_rng(seed)
    k, small = len(shares), lambda *s: rng.normal(0, 0.3, s)
    w = {"E": small(k, width), "P": small(2 * stride, width), "Wq": small(width, width), "Wk": small(width, width),
         "Wv": small(width, width), "Wo": small(width, width), "U": np.zeros((width, k)), "b": np.log(shares)}
    if tail is None or len(tail) < 2:  # one id is the class itself
        return w
    size = math.isqrt(len(tail) - 1) + 1
    padded = np.zeros((-(-len(tail) // size), size))
    padded.ravel()[:len(tail)] = tail
    total = padded.sum(1, keepdims=True)
    inside = np.where(padded > 0, np.log(np.maximum(padded, 1e-300) / total), -1e9)
    return w | {"T": small(len(tail), width), "G": np.zeros((width, len(padded))), "g": np.log(total[:, 0] / total.sum()),
                "S": np.zeros((*padded.shape, width)), "s": inside}


def inputs_of(w: dict[str, np.ndarray]) -> np.ndarray:
    """Input vectors of the classes and, behind them, of the tail's ids."""
    return np.concatenate([w["E"], w["E"][-2] + w["T"]]) if "T" in w else w["E"]


@lru_cache(maxsize=2)
def _cells(size: int, d: int) -> np.ndarray:
    return np.arange(size * d).reshape(size, d)


def _sums(place: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by place, of ``size`` places."""
    d = rows.shape[1]
    at = _cells(size, d).take(place, 0)
    return np.bincount(at.ravel(), weights=rows.ravel(), minlength=size * d).reshape(size, d).astype(rows.dtype)


def spans_of(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by group, (group, first, behind the last) of each)."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()] if len(own) else []
    return order, list(zip(own[cut].tolist(), cut, [*cut[1:], len(own)], strict=True)) if cut else []


def id_logits(ids: np.ndarray, bias: np.ndarray, h: np.ndarray, group: np.ndarray, spans: list) -> np.ndarray:
    """Logits of the ids of each context's group; the contexts lie by group."""
    out = np.empty((len(h), bias.shape[1]), h.dtype)
    for g, lo, hi in spans:
        np.dot(h[lo:hi], ids[g].T, out=out[lo:hi])
    out += bias[group]
    return out


def exp_rows(logit: np.ndarray, seen: np.ndarray | None = None):
    """(exp(logit - low), its sums by row, low by row) over the last axis, 0 where ``seen`` is 0.

    ``low`` is 0 as long as the sums neither overflow nor vanish, else the greatest seen logit of each row: a row's
    maximum costs more than the exponentials.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.exp(logit)
        if seen is not None:
            out *= seen
        total = out @ np.ones(out.shape[-1], out.dtype)
    if not len(total) or (np.minimum.reduce(total, None) > 1e-20 and np.maximum.reduce(total, None) < 1e20):
        return out, total, 0.0
    if seen is not None:
        logit = np.where(seen > 0, logit, logit.dtype.type(-1e9))
    low = logit.max(-1, keepdims=True)
    out = np.exp(logit - low)
    return out, out.sum(-1), low[..., 0]


def _row_max(a: np.ndarray) -> np.ndarray:
    """Maxima over the last axis of an array in C order; NumPy's short reductions cost more.

    They are found by their places, in narrow rows by a copy with the rows side by side.
    """
    width = a.shape[-1]
    if width < 64:
        return np.ascontiguousarray(a.reshape(-1, width).T).max(0).reshape(*a.shape[:-1], 1)
    at = a.reshape(-1, width).argmax(1)
    at += np.arange(0, a.size, width)
    return a.ravel().take(at).reshape(*a.shape[:-1], 1)


def _softmax(logit: np.ndarray) -> np.ndarray:
    logit -= _row_max(logit)
    np.exp(logit, out=logit)
    logit /= logit.sum(1, keepdims=True)
    return logit


@lru_cache(maxsize=4)
def _unseen(size: int, kind: np.dtype) -> np.ndarray:
    return np.where(np.tri(size, dtype=bool), kind.type(0), kind.type(-1e9))


def _attention(logit: np.ndarray) -> np.ndarray:
    """Causal softmax over the last axis."""
    out = logit - _row_max(logit)
    out += _unseen(logit.shape[1], logit.dtype)
    np.exp(out, out=out)
    total = out.sum(2, keepdims=True)
    if not total.min(initial=1) > 1e-20:  # a later input's logit dwarfs all that a target may see
        out = np.where(np.tri(logit.shape[1], dtype=bool), logit, logit.dtype.type(-1e9))
        out = np.exp(out - _row_max(out))
        total = out.sum(2, keepdims=True)
    out /= total
    return out


def tail_gradients(w: dict[str, np.ndarray], h: np.ndarray, t: np.ndarray, live: int, with_loss: bool = True):
    """(summed loss / live, gradients, dh) of the tail's ids ``t`` after the contexts ``h``."""
    i, scale, size = np.arange(len(t)), h.dtype.type(1 / live), w["s"].shape[1]
    order, spans = spans_of(t // size)
    (group, place), h = np.divmod(t[order], size), h[order]
    a = _softmax(h @ w["G"] + w["g"])
    b = _softmax(id_logits(w["S"], w["s"], h, group, spans))
    loss = -np.log(a[i, group] * b[i, place] + 1e-12).sum() / live if with_loss else 0.0
    a[i, group] -= 1
    b[i, place] -= 1
    a *= scale
    b *= scale
    g = {"G": h.T @ a, "g": a.sum(0), "S": np.zeros_like(w["S"]), "s": np.zeros_like(w["s"])}
    dh = np.empty_like(h)
    inner = np.empty_like(h)
    for n, lo, hi in spans:
        np.dot(b[lo:hi].T, h[lo:hi], out=g["S"][n])
        np.dot(b[lo:hi], w["S"][n], out=inner[lo:hi])
    if spans:
        g["s"][[n for n, *_ in spans]] = np.add.reduceat(b, [lo for _, lo, _ in spans])
    inner += a @ w["G"].T
    dh[order] = inner
    return loss, g, dh


def pack(w: dict[str, np.ndarray], out: np.ndarray | None = None) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)], out=out)


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, with_loss: bool = True):
    """(loss, gradients) of the mean log loss over the targets ``y >= 0`` of a batch of windows of inputs ``x``.

    Without ``with_loss`` the loss is left at 0. A target sees the inputs of its window up to its own place. Numbers
    from the classes on are ids of the tail. All matrices keep the dtype of the weights.
    """
    (n, s), (k, d), kind = x.shape, w["E"].shape, w["E"].dtype
    scale, flat = kind.type(1 / np.sqrt(d)), x.ravel()
    e = (inputs_of(w).take(flat, 0).reshape(n, s, d) + w["P"][:s]).reshape(-1, d)
    project = np.concatenate([w["Wq"] * scale, w["Wk"], w["Wv"]], axis=1)
    qkv = (e @ project).reshape(n, s, 3 * d)
    q, key, v = qkv[:, :, :d], qkv[:, :, d:2 * d], qkv[:, :, 2 * d:]
    att = _attention(np.matmul(q, key.transpose(0, 2, 1)))
    z = np.matmul(att, v).reshape(-1, d)
    h = e + z @ w["Wo"]
    p = h @ w["U"]
    p += w["b"]
    p -= _row_max(p)
    np.exp(p, out=p)
    total = p.sum(1)
    row = np.flatnonzero(y.ravel() >= 0)
    exact, live = y.ravel()[row], max(1, len(row))
    target = np.where(exact < k, exact, k - 2)
    loss = -np.log(p[row, target] / total[row] + 1e-12).sum() / live if with_loss else 0.0
    p *= ((y.ravel() >= 0).astype(kind) / (total * kind.type(live)))[:, None]
    p[row, target] -= kind.type(1 / live)
    g = {"U": h.T @ p, "b": p.sum(0)}
    dh = p @ w["U"].T
    if "T" in w:
        rare = row[exact >= k]
        more, tail, dt = tail_gradients(w, h[rare], exact[exact >= k] - k, live, with_loss)
        loss += more
        g.update(tail)
        dh[rare] += dt
    g["Wo"] = z.T @ dh
    dz = (dh @ w["Wo"].T).reshape(n, s, d)
    ds = np.matmul(dz, v.transpose(0, 2, 1))
    ds -= np.einsum("bij,bij->bi", ds, att)[:, :, None]
    ds *= att
    dqkv = np.empty_like(qkv)
    np.matmul(ds, key, out=dqkv[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d:2 * d])
    np.matmul(att.transpose(0, 2, 1), dz, out=dqkv[:, :, 2 * d:])
    flow = dqkv.reshape(-1, 3 * d)
    dw = e.T @ flow
    g["Wq"], g["Wk"], g["Wv"] = dw[:, :d] * scale, dw[:, d:2 * d], dw[:, 2 * d:]
    de = flow @ project.T + dh
    g["P"] = np.zeros_like(w["P"])
    g["P"][:s] = de.reshape(n, s, d).sum(0)
    by_input = _sums(flat, de, k + len(w.get("T", ())))
    g["E"] = by_input[:k]
    if "T" in w:
        g["T"] = by_input[k:]
        g["E"][k - 2] += g["T"].sum(0)
    return loss, g


class Scorer:
    """log10 P(id | context) - log10 share(id), summed by text; ids of the tail are numbered from the classes on."""

    def __init__(self, w: dict[str, np.ndarray], shares: np.ndarray, tail: np.ndarray | None = None):
        f = lambda a: np.ascontiguousarray(a, np.float32)
        s = self.stride = len(w["P"]) // 2
        scale, e = 1 / np.sqrt(w["E"].shape[1]), inputs_of(w)
        self.q = f(e @ w["Wq"] * scale), f(w["P"][s:] @ w["Wq"] * scale)
        both = np.concatenate([w["Wk"], w["Wv"]], axis=1)
        self.kv = f(e @ both), f(w["P"] @ both)
        self.causal = np.tri(2 * s, dtype=np.float32)[s:]
        self.context, self.out = (f(e), f(w["P"][s:]), f(w["Wo"])), (f(w["U"]), f(w["b"]))
        self.share = np.log(shares)
        self.tail = "T" in w
        if self.tail:
            self.groups, self.members = (f(w["G"]), f(w["g"])), (f(w["S"]), f(w["s"]))
            self.tail_share = np.log(tail / tail.sum())

    def _tail_gains(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log P(id | context, tail) - log share(id | tail) of ids ``t`` after contexts h."""
        size = self.members[1].shape[1]
        order, spans = spans_of(t // size)
        h, own = h[order], t[order]
        total = -self.tail_share[own]
        for logit, at in ((h @ self.groups[0] + self.groups[1], own // size),
                          (id_logits(*self.members, h, own // size, spans), own % size)):
            _, mass, low = exp_rows(logit)
            total += logit[np.arange(len(own)), at] - low - np.log(mass)
        out = np.empty(len(t))
        out[order] = total
        return out

    def gains(self, texts: list[np.ndarray], end: int, chunk: int = 128) -> np.ndarray:
        """By text of class or tail ids (each closed by ``end``): the gain in log10."""
        s, classes = self.stride, len(self.share)
        size = np.array([len(t) for t in texts], np.int64)
        n = -(-size // s)
        # every text stands behind one stride of padding and starts from an end
        room = s + n * s
        base = np.cumsum(room) - room
        x = np.full(int(room.sum()), end, np.int64)
        y = np.full(int(room.sum()), -1, np.int64)
        for t, b in zip(texts, base.tolist(), strict=True):
            x[b + s + 1:b + s + len(t)] = t[:-1]
            y[b + s:b + s + len(t)] = t
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, first = np.repeat(base, n) + s * place, place == 0
        gain = np.zeros(len(start))
        held: list[tuple[np.ndarray, ...]] = []  # (window, context, id) of the tail, worked through many at a time
        waiting = 0

        def close() -> None:
            window, h, t = (np.concatenate(a) for a in zip(*held, strict=True))
            held.clear()
            np.add.at(gain, window, self._tail_gains(h, t))

        for lo in range(0, len(start), chunk):
            at = start[lo:lo + chunk, None] + np.arange(2 * s)
            xs, exact = x[at], y[at[:, s:]]
            ys = np.where(exact < classes, exact, classes - 2)
            q = self.q[0].take(xs[:, s:], 0)
            q += self.q[1]
            kv = self.kv[0].take(xs, 0)
            kv += self.kv[1]
            k, v = kv[:, :, :q.shape[2]], kv[:, :, q.shape[2]:]
            logit = np.matmul(q, k.transpose(0, 2, 1))
            logit[first[lo:lo + chunk], :, :s] = -1e9  # the padding before a text; what is behind it, no target sees
            att, mass, _ = exp_rows(logit, self.causal)
            z = np.matmul(att, v)
            z /= mass[:, :, None]
            h = self.context[0].take(xs[:, s:], 0)
            h += self.context[1]
            h += (z.reshape(-1, z.shape[2]) @ self.context[2]).reshape(h.shape)
            logit = h.reshape(-1, h.shape[2]) @ self.out[0]
            logit += self.out[1]
            _, total, low = exp_rows(logit)
            target = logit[np.arange(len(logit)), np.maximum(ys, 0).ravel()]
            gain[lo:lo + chunk] = np.where(ys >= 0, (target - low - np.log(total)).reshape(ys.shape)
                                           - self.share[np.maximum(ys, 0)], 0).sum(1)
            if self.tail:
                i, j = np.nonzero(exact >= classes)
                held.append((lo + i, h[i, j], exact[i, j] - classes))
                waiting += len(i)
                if waiting >= 8192:
                    close()
                    waiting = 0
        if held:
            close()
        return np.bincount(owner, weights=gain, minlength=len(texts)) / np.log(10)


# -- Spark jobs ------------------------------------------------------------------------

def pack_corpus(rows: DataFrame, model: bytes, rounds: int = ROUNDS) -> DataFrame:
    """One pass over (text binary, held_out): the rows of ``read_corpus``, the words as packs of ``PACK`` records.

    A pack is one value, so that storing the pass and reading the runs from it does not cost a row a word.
    """
    import pyarrow as pa
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("turn", pa.int32()), ("run", pa.binary()), ("words", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, turn = lead_pieces(shared.value), 0
        held: list[tuple[np.ndarray, ...]] = []  # (hash, leading id, n, m) of the words so far

        def table(columns: dict) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema],
                                              schema=schema)

        def merged() -> tuple[np.ndarray, ...]:
            h, piece, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, place = np.unique(h, return_index=True, return_inverse=True)
            return (h, piece[first], *(np.bincount(place, weights=x).astype(np.int64) for x in (n, m)))

        def packs(words: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            records = np.empty(len(words[0]), WORD)
            for name, x in zip(WORD.names, words, strict=True):
                records[name] = x
            for at in range(0, len(records), PACK):
                yield table({"words": [records[at:at + PACK].tobytes()]})

        for batch in batches:
            texts, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(texts), 512):
                size, inverse, distinct, piece = distinct_tokens(texts[lo:lo + 512], lead)
                taught = ~out[lo:lo + 512]
                own = inverse[np.repeat(taught, size)]
                held.append((distinct, piece, np.bincount(own, minlength=len(distinct)),
                             np.bincount(inverse, minlength=len(distinct))))
                ids = np.append(piece, END_PIECE).astype(np.int32)
                cut = np.cumsum(size) - size
                runs, turns = [], []
                for a, k in zip(cut[taught].tolist(), size[taught].tolist(), strict=True):
                    run = ids[np.append(len(distinct), inverse[a:a + k])]
                    runs += [run[at:at + RUN + 1].tobytes() for at in range(0, k, RUN)]
                    turns += [turn % rounds] * (len(runs) - len(turns))
                    turn += 1
                if runs:
                    yield table({"turn": turns, "run": runs})
                if sum(len(x[0]) for x in held) > 2 * MAX_WORDS:
                    held = [merged()]
                    if len(held[0][0]) > MAX_WORDS:
                        yield from packs(held.pop())
        if held:
            yield from packs(merged())

    return rows.select("text", "held_out").mapInArrow(read, "turn int, run binary, words binary")


def word_rows(packed: DataFrame) -> DataFrame:
    """Rows (h, piece, n, m) of the packs of ``pack_corpus``."""
    import pyarrow as pa

    def unpack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack_ in batch.column(0):
                records = np.frombuffer(pack_.as_buffer(), WORD)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records[name])) for name in WORD.names],
                                                 list(WORD.names))

    return packed.filter("words IS NOT NULL").select("words").mapInArrow(
        unpack_words, "h long, piece int, n long, m long")


def read_corpus(rows: DataFrame, model: bytes, rounds: int = ROUNDS) -> DataFrame:
    """Of (text binary, held_out): counts of words, and the training documents as runs of leading ids.

    Word rows are (h, piece, n in training, m in all); a run is (turn, run): a first input and the ids of up to
    ``RUN`` tokens that follow it, the end of the document being one.
    """
    packed = pack_corpus(rows, model, rounds)
    return word_rows(packed).unionByName(packed.filter("run IS NOT NULL").select("turn", "run"), allowMissingColumns=True)


def class_table(by_piece, classes: int = CLASSES) -> tuple[dict[int, int], np.ndarray]:
    """({piece: class}, class shares) from rows (piece, n, v); the last class is the end's."""
    rows = sorted(((r["n"], -r["piece"], r["v"]) for r in by_piece if r["piece"] != END_PIECE), reverse=True)
    of = {-p: i for i, (_, p, _) in enumerate(rows[:classes - 2])}
    of[END_PIECE] = classes - 1
    mass = np.full(classes, 1 / classes)
    for r in by_piece:
        mass[of.get(r["piece"], classes - 2)] += r["n"] + r["v"]
    return of, mass / mass.sum()


def tail_table(by_piece, of: dict[int, int], classes: int = CLASSES) -> tuple[dict[int, int], np.ndarray]:
    """({piece: place}, shares) of the ids without a class, most frequent first; the last place is for unseen ids."""
    rows = sorted((-r["n"], r["piece"], r["n"] + r["v"]) for r in by_piece if r["piece"] not in of)
    mass = np.array([m for _, _, m in rows] + [1 / classes])
    return {p: i for i, (_, p, _) in enumerate(rows)}, mass / mass.sum()


def training_windows(runs: list[np.ndarray], end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) in windows of ``size`` from runs of classes; a target of -1 is padding.

    The first class of a run is the input of its second; every other class is a target once.
    """
    n = np.array([len(r) - 1 for r in runs], np.int64)
    room = -(-n // size) * size
    base = np.cumsum(room) - room
    at = np.arange(n.sum()) + np.repeat(base - (np.cumsum(n) - n), n)
    x, y = np.full(int(room.sum()), end), np.full(int(room.sum()), -1)
    if len(at):
        x[at] = np.concatenate([r[:-1] for r in runs])
        y[at] = np.concatenate([r[1:] for r in runs])
    return x.reshape(-1, size), y.reshape(-1, size)


def train(runs: DataFrame, of: dict[int, int], shares: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH,
          rate: float = RATE, tail: tuple[dict[int, int], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks after each round of local Adam steps over its documents."""
    import pyarrow as pa
    start, classes = initial(shares, tail=tail and tail[1]), len(shares)
    flat = pack(start)
    if "T" in start:
        of = of | {p: classes + i for p, i in tail[0].items()}
    known = np.array(sorted(of), np.int64)
    class_of = np.full(int(known.max()) + 3, classes - 2)
    class_of[known] = [of[k] for k in known.tolist()]  # the end's id is the last place, ids beyond use the one before
    for r in range(rounds):
        shared = runs.sparkSession.sparkContext.broadcast((flat, start, class_of))
        step = rate * 0.6 ** r

        def local(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            flat_, like, class_ = shared.value
            now = flat_.astype(np.float32)
            w = unpack(now, like)  # views: Adam works in place
            m, v, d, part = (np.zeros_like(now) for _ in range(4))
            seen = t = 0
            for b in batches:
                raw = b.column(0).to_pylist()
                for at in range(0, len(raw), 64):
                    ids = [np.frombuffer(x, np.int32) for x in raw[at:at + 64]]
                    cls = class_[np.minimum(np.concatenate(ids), len(class_) - 2)]
                    x, y = training_windows(np.split(cls, np.cumsum([len(i) for i in ids])[:-1]), classes - 1,
                                            2 * STRIDE)
                    for lo in range(0, len(x), batch):
                        _, g = gradients(w, x[lo:lo + batch], y[lo:lo + batch], with_loss=False)
                        t += 1
                        pack(g, out=d)
                        m *= np.float32(0.9)
                        v *= np.float32(0.99)
                        m += np.multiply(d, np.float32(0.1), out=part)
                        np.multiply(d, np.float32(0.01), out=part)
                        v += np.multiply(part, d, out=part)
                        np.divide(v, np.float32(1 - 0.99 ** t), out=d)
                        np.sqrt(d, out=d)
                        d += np.float32(1e-8)
                        np.multiply(m, np.float32(step / (1 - 0.9 ** t)), out=part)
                        now -= np.divide(part, d, out=part)
                    seen += len(x)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(now)), pa.int32()), pa.array(now.astype(np.float64) * seen, pa.float64()),
                     pa.array(np.full(len(now), seen), pa.int64())], ["i", "v", "n"])

        mean = (runs.filter(F.col("turn") == r).select("run").mapInArrow(local, "i int, v double, n long").groupBy("i")
                .agg((F.sum("v") / F.sum("n")).alias("v")).collect())
        for row in mean:
            flat[row["i"]] = round(row["v"], 6)
    return unpack(flat, start)


def _level():
    """Eighths of a binary order of magnitude of a count: a few hundred levels at most."""
    return F.floor(8 * F.log2("m")).cast("int")


def head_words(counts: DataFrame, head: int) -> tuple:
    """(least count level of the head as a column, its rows): whole levels from the top, at most ``head`` words.

    Only the sizes of the levels and the head itself reach the driver.
    """
    sizes = {r["l"]: r["v"] for r in counts.groupBy(_level().alias("l")).agg(F.count("*").alias("v")).collect()}
    least, total = None, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > head:
            break
        least = level
    column = F.lit(least).cast("int")
    return column, [] if least is None else counts.filter(_level() >= column).select("h", "n").collect()


def score_documents(docs: DataFrame, vocabulary_path: str, classes: int = CLASSES, head: int = HEAD,
                    rounds: int = ROUNDS) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Row numbers are those of the scan, so ``docs`` should be a table read as it lies.
    """
    import pyarrow as pa
    with open(vocabulary_path, "rb") as f:
        model = f.read()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"),
                       held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    corpus = cut_lineage(pack_corpus(rows, model, rounds))
    counts = cut_lineage(word_rows(corpus).groupBy("h").agg(
        F.min("piece").alias("piece"), F.sum("n").alias("n"), F.sum("m").alias("m")))
    by_piece = counts.filter("n > 0").groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n_all, v_all = sum(r["n"] for r in by_piece), sum(r["v"] for r in by_piece)
    of, shares = class_table(by_piece, classes)
    tail = tail_table(by_piece, of, classes)
    weights = train(corpus.filter("run IS NOT NULL").select("turn", "run"), of, shares, rounds,
                    tail=tail) if n_all else None
    least, top = head_words(counts, head)
    top = np.array(sorted((r["h"], r["n"]) for r in top), np.int64).reshape(-1, 2)
    shared = docs.sparkSession.sparkContext.broadcast((top, of, shares, tail, weights, model))
    scale = float(np.log10(n_all + (v_all + 1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_, of_, shares_, (tail_of, tail_shares), weights_, model_ = shared.value
        lead, head_h, head_n = lead_pieces(model_), np.append(head_[:, 0], 0), np.append(head_[:, 1], 0)
        scorer = Scorer(weights_, shares_, tail_shares) if weights_ else None
        numbers_, unseen = of_, classes - 2
        if scorer and scorer.tail:
            numbers_, unseen = of_ | {p: classes + i for p, i in tail_of.items()}, classes + len(tail_of)
        classes_ = np.full(int(max([0, *numbers_])) + 2, unseen)
        for p, c in numbers_.items():
            classes_[p] = c  # the end's id is the last place
        for batch in batches:
            texts, numbers = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for lo in range(0, len(texts), 256):
                size, inverse, distinct, piece = distinct_tokens(texts[lo:lo + 256], lead)
                row = np.repeat(np.arange(len(size)), size)
                place = np.minimum(np.searchsorted(head_h[:-1], distinct), len(head_h) - 1)
                count = np.where((head_h[place] == distinct) & (place < len(head_h) - 1), head_n[place], -1)
                own = count[inverse]
                named = piece < len(classes_) - 1
                cls = np.where(named, classes_[np.where(named, piece, 0)], unseen)
                gain = (scorer.gains(np.split(cls[inverse], np.cumsum(size)[:-1]), classes - 1) if scorer
                        else np.zeros(len(size)))
                base = np.bincount(row, weights=np.log10(np.maximum(own, 0) + 1.0), minlength=len(size)) - size * scale
                known = np.bincount(row[own > 0], minlength=len(size))
                # the words outside the head, once per text and word
                rest, times = np.unique((row * len(distinct) + inverse)[own < 0], return_counts=True)
                rest = np.divmod(rest, len(distinct))
                number = numbers[lo:lo + 256]
                none = pa.nulls(len(times), pa.int64()), pa.nulls(len(times), pa.float64())
                both = lambda x, i: pa.concat_arrays([pa.array(x), none[i]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([number, number[rest[0]]])),
                     pa.array(np.concatenate([number, distinct[rest[1]]])),
                     pa.array(np.concatenate([np.zeros(len(size), np.int64), times.astype(np.int64)])),
                     both(size.astype(np.int64), 0), both(known.astype(np.int64), 0), both(base, 1), both(gain, 1)],
                    ["row", "h", "k", "n_tokens", "n_head", "base", "gain"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    part = numbered.select("row", "text").mapInArrow(
        scan, "row long, h long, k long, n_tokens long, n_head long, base double, gain double")
    rare = counts.filter((F.col("n") > 0) & (least.isNull() | (_level() < least))).select(F.col("h").alias("c_h"), F.col("n").alias("c"))
    met = part.join(rare, (part["h"] == rare["c_h"]) & (part["k"] > 0), "left")
    sums = met.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("n_tokens", "n_head", "base", "gain")], F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("tail"))
    base = F.col("base") + F.col("tail")
    return numbered.select("row", "doc_id", "held_out").join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("more")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base + F.col("gain")).alias("score"))
