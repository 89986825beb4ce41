"""Token counts of a public byte-level BPE vocabulary by the whole-token shortcut.

Before the scan the driver proves, by running the vocabulary's own merges on
each of its strings, which ones encode alone as exactly one token (a string
of the vocabulary need not: its merges may prefer another split). Inside the
tasks a text is cut into pre-tokens; one that is a proven string counts one
token at once, only the others are merged, and their lengths are kept in a
bounded table per task. Special strings are cut out first and count one each,
as the library does by default.

The scan is one pass of Arrow batches without a shuffle. The vocabulary file
is read on the driver and broadcast: its size is that of the vocabulary and
does not depend on the data.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows are counted each on its own; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Merged pre-tokens kept per task; the table is emptied when full.
MAX_MERGED = 500_000
# Fixed value: the published pre-token pattern of this vocabulary, its white
# space written out as the library's engine understands it.
_WS = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|["
           + _WS + "]+(?![^" + _WS + "])|[" + _WS + "]+")


def byte_letters() -> list[str]:
    """The vocabulary's letter for each byte: printable ones as they are, the rest from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=4)
def load(definition: str):
    """(tokenizer, its special strings) from the text of a tokenizer file."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(definition)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    return tok, sorted(special, key=len, reverse=True)


def whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token, as text."""
    tok, special = load(definition)
    back = {c: b for b, c in enumerate(byte_letters())}
    proven = set()
    for piece in tok.get_vocab(with_added_tokens=False):
        if piece in special or any(c not in back for c in piece):
            continue
        merged = tok.model.tokenize(piece)
        if len(merged) == 1 and merged[0].value == piece:
            try:
                proven.add(bytes(back[c] for c in piece).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character is never a pre-token
                continue
    return frozenset(proven)


class _Costs(dict):
    """Tokens by pre-token: proven strings cost one, others are merged when first met."""

    def __init__(self, definition: str, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.model = proven, load(definition)[0].model
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, pre: str) -> int:
        n = len(self.model.tokenize(pre.encode().decode("latin-1").translate(self.letters)))
        if len(self) > len(self.proven) + MAX_MERGED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        self[pre] = n
        return n


def counter(definition: str, proven: frozenset[str]):
    """A function from a text to its number of tokens."""
    import regex
    find, costs, special = regex.compile(PATTERN).findall, _Costs(definition, proven), load(definition)[1]
    split = regex.compile("|".join(regex.escape(s) for s in special)).split if special else None

    def count(text: str) -> int:
        if split and any(s in text for s in special):
            parts = split(text)
            return sum(sum(map(costs.__getitem__, find(p))) for p in parts) + len(parts) - 1
        return sum(map(costs.__getitem__, find(text)))
    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""
    import pyarrow as pa
    definition = read_text(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*shared.value)
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
            .mapInArrow(scan, f"doc_id {id_type}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
