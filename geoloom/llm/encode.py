"""Encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

A text is cut into pieces by the tokenizer's public pattern; each piece is encoded alone.  For a piece, every prefix has
exactly one encoding and so exactly one last token.  The tokens that end at a position are the matches that a suffix
automaton over the vocabulary reports there; of them exactly one fits: the one that is compatible with the last token of
the prefix before it.  Two adjacent tokens are compatible if merging the bytes of both gives these two tokens again; an
encoding is the exact one if and only if all its adjacent tokens are.  The last token of every prefix is kept, and the
back-pointers are followed from the end.

Work is linear in the text (times the few matches that end at one position).  Pieces repeat, so their ids are remembered
in a bounded table per worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import public_tokenizers as _public

    VOCABULARY, PATTERN = _public.path("byte_bpe_50k.tiktoken"), _public.PATTERN
except ImportError:  # the vocabulary is a parameter; these are the defaults
    VOCABULARY, PATTERN = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_REMEMBER = 400_000  # pieces, and pairs, kept by a worker


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.cut = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ends = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if self._merge(token) == [rank]:  # a token that its own bytes don't give is never used
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging, for one or two tokens' worth of bytes: the least rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _REMEMBER:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        last: list[tuple[int, int] | None] = [None] * len(data)  # per prefix: length and id of its last token
        for end, (size, token) in self.ends.iter(data.decode("latin-1")):
            if last[end] is None or size == len(data):
                start = end - size
                if start < 0 or (last[start] is not None and self._fits(last[start][1], token)):
                    last[end] = (size, token)
        if whole is not None and last[-1] and last[-1][1] == whole:
            return (whole,)
        out, at = [], len(data) - 1
        while at >= 0:
            size, token = last[at]  # every prefix has its one last token
            out.append(token)
            at -= size
        return tuple(reversed(out))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces, out = self.pieces, []
        for m in self.cut.finditer(text):
            piece = m.group()
            known = pieces.get(piece)
            if known is None:
                known = self._piece(piece)
                if len(piece) <= 64:
                    if len(pieces) >= _REMEMBER:
                        pieces.clear()
                    pieces[piece] = known
            out.extend(known)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One for each worker process."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def encoded(text: str | Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """array<int> of token ids without special tokens; what spells one is ordinary text; null and empty give [].

    ``vocabulary`` is a path that every executor can read.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary, pattern)
        for batch in batches:
            yield batch.map(lambda t: e.ids(t) if isinstance(t, str) else [])

    return run(text)


def token_count(text: str | Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of token ids of a text; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary, pattern)
        for batch in batches:
            yield batch.map(lambda t: len(e.ids(t)) if isinstance(t, str) else 0).astype("int32")

    return run(text)
