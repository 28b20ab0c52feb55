"""Encoding of a corpus with a public byte-level BPE vocabulary.

Token bytes are mapped to Latin-1 text for an Aho-Corasick automaton.  A piece
is encoded by taking the longest token at each position and backtracking where
it does not fit the token before it; whether two tokens may stand side by side
under the merges is memoised.  Every position is dropped at most once, so the
time is linear in the piece, and the result is exactly that of the merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.plans.lineage import spread

#: The pattern that splits text before the merges (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie.
FOLDER = "/opt/tokenizers"
#: Pieces and pairs remembered by a worker before it forgets them all.
REMEMBERED = 200_000


def read_ranks(path: str) -> list[str]:
    """Tokens of a rank file in order of rank, as Latin-1 text."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token).decode("latin-1")
    return tokens


class Encoder:
    """Exact BPE by backtracking over longest matches."""

    def __init__(self, tokens: list[str]):
        import ahocorasick
        import regex

        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            self.halves.append(self._halve(i, t))
        self.fits.clear()
        self.pieces: dict[str, list[int]] = {}

    def _halve(self, i: int, t: str) -> tuple[int, int]:
        """The two tokens whose merge makes token i; itself twice for a single byte."""
        for cut in range(len(t) - 1, 0, -1):
            a, b = self.ids.get(t[:cut], i), self.ids.get(t[cut:], i)
            if a < i and b < i and self._may_follow(a, b):
                self.merged[a, b] = i
                return a, b
        return i, i

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` standing side by side.

        Their inner borders are opened, the later merge first; a merge across the
        border that ranks before the one just opened would have come earlier.
        """
        limit = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                opened, inner = left, self.halves[left][1]
                if inner != opened:
                    limit, left = opened, inner
                    continue
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                opened, inner = right, self.halves[right][0]
                if inner != opened:
                    limit, right = opened + 1, inner
                    continue
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def _side_by_side(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[left, right] = self._may_follow(left, right)
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given as text."""
        data = text.encode("utf-8").decode("latin-1")
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        # tokens that start at a position, the shortest first
        at: list[list[int]] = [[] for _ in range(size)]
        lengths = self.tokens
        for end, i in self.automaton.iter(data):
            at[end + 1 - len(lengths[i])].append(i)
        open_ = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        choice = [len(a) for a in at]
        pos = 0
        while pos < size:
            while choice[pos]:
                choice[pos] -= 1
                token = at[pos][choice[pos]]
                end = pos + len(lengths[token])
                if open_[end] and (not out or self._side_by_side(out[-1], token)):
                    out.append(token)
                    pos = end
                    if pos < size:
                        choice[pos] = len(at[pos])
                    break
            else:
                # nothing fits here: no encoding passes through this position
                if not out:
                    raise ValueError("the vocabulary cannot express this text")
                open_[pos] = 0
                pos -= len(lengths[out.pop()])
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_WORKER: dict[str, Encoder] = {}


def _encoder(key: str, tokens: list[str]) -> Encoder:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(tokens)
    return _WORKER[key]


def encode_corpus(docs: DataFrame, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, ids``: the token ids of each text, without special tokens.

    Null and empty texts have the empty list.  Strings of special tokens are
    ordinary text.  Whole texts are encoded, however long; repeated rows give
    repeated rows; other columns are not read.  One pass of Arrow batches.  The vocabulary (a bounded file) goes to the executors as a broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    key = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared.value)
        for b in batches:
            ids = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["ident", "ids"])

    kind = docs.schema[ident].dataType
    schema = T.StructType([T.StructField("ident", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")), "ident").mapInArrow(run, schema).withColumnRenamed("ident", ident)
