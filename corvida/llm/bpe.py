"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one encoding, and so exactly one last
token. The table of last tokens is filled from left to right: the last token
of a prefix is the one token that ends there and forms a valid pair with the
last token of the prefix before it. The encoding is read off backwards. A pair
of tokens is valid if merging their joined bytes by rank would leave the
border between them alone, which the merge trees of both decide.

Prefixes never change when bytes are appended, so ``Prefixes.append`` only
fills new places; ``Prefixes.replace`` keeps what stands before the edit and
stops as soon as as many places as the longest token has bytes agree with the
old ones after it.

A text is split by the tokenizer's pattern and each match is encoded alone.
Null texts count as empty: no token, digests of nothing. Rows that repeat a
``doc_id`` each get a row; extra columns are ignored; an empty table gives an
empty result. Memory is bounded by the longest text of a batch and a cache of
encoded pieces and prefixes that is emptied when full.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvida.llm.common import map_texts, worker_state

CACHE_PIECES = 400_000
CACHE_PREFIXES = 700_000
CACHE_PAIRS = 500_000
_CACHE_PIECE_BYTES = 64
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, merge trees and the validity of pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Bytes of the longest token with each ending of three bytes.
        self.longest_with: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > self.longest_with.get(token[-3:], 2):
                self.longest_with[token[-3:]] = len(token)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.sides: dict[int, tuple[int, int] | None] = {}
        self.left: dict[int, list[tuple[bytes, int, int]]] = {}
        self.right: dict[int, list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; itself twice if merges never reach it; None for a byte."""
        if token not in self.sides:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if best == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.sides[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.sides[token]

    def reachable(self, token: int) -> bool:
        return self.split(token) != (token, token)

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens that stand at a side of ``token`` while it is merged, last first: bytes, rank, rank of what takes it in."""
        known = (self.left, self.right)[side]
        if token not in known:
            out, until, now = [], _NEVER, token
            while True:
                out.append((self.bytes_of[now], now, until))
                parts = self.split(now)
                if parts is None or parts == (now, now):
                    break
                until, now = now, parts[side]
            known[token] = out
        return known[token]

    def valid(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what their joined bytes encode to."""
        got = self.pairs.get((a, b))
        if got is None:
            ends, starts = self._edge(a, 1), self._edge(b, 0)
            i = j = 0
            got = True
            while True:
                x, rank_x, until_x = ends[i]
                y, rank_y, until_y = starts[j]
                merged = self.ranks.get(x + y, _NEVER)
                # of merges of one rank the leftmost is done first
                if merged < until_x and merged <= until_y and merged != _NEVER:
                    got = False
                    break
                if i + 1 < len(ends) and (rank_x > rank_y or j + 1 == len(starts)):
                    i += 1
                elif j + 1 < len(starts):
                    j += 1
                else:
                    break
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got


class Prefixes:
    """The last token of every prefix of a piece's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, end: int) -> int:
        data, last, ranks, valid = self.data, self.last, self.v.ranks, self.v.valid
        for start in range(max(0, end - self.v.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and (valid(last[start], token) if start else self.v.reachable(token)):
                return token
        raise ValueError("no last token: the vocabulary is no set of merges")

    def append(self, data: bytes) -> Prefixes:
        self.data += data
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._fill(end))
        return self

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes ``start`` to ``stop``; returns how many places were filled anew."""
        old, moved = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        same = filled = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._fill(end))
            filled += 1
            before = end - moved
            same = same + 1 if end >= start + len(data) and before > stop and old[before] == self.last[end] else 0
            if same >= self.v.longest:
                self.last += old[before + 1 :]
                break
        return filled

    def ids(self) -> list[int]:
        if (whole := self.v.ranks.get(self.data)) is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes_of[self.last[end]])
        return out[::-1]


class _Pieces(dict):
    """Encoded pieces as little-endian 32-bit ids.

    Last tokens are kept by prefix over all pieces, so a piece is filled from
    its longest prefix that any earlier piece had. Long pieces aren't kept.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.last: dict[bytes, int] = {b"": -1}

    def _ids(self, data: bytes) -> list[int]:
        last, rank_of, pair_of, longest_with = self.last, self.v.ranks.get, self.v.pairs.get, self.v.longest_with.get
        if len(last) > CACHE_PREFIXES:
            last.clear()
            last[b""] = -1
        n = known = len(data)
        while data[:known] not in last:
            known -= 1
        for end in range(known + 1, n + 1):
            first = end - longest_with(data[end - 3 : end] if end > 2 else data[:end], 2)
            for start in range(first if first > 0 else 0, end):
                token = rank_of(data[start:end])
                if token is None:
                    continue
                if not start:
                    good = self.v.reachable(token)
                else:
                    before = last[data[:start]]
                    good = pair_of((before, token))
                    if good is None:
                        good = self.v.valid(before, token)
                if good:
                    last[data[:end]] = token
                    break
            else:
                raise ValueError("no last token: the vocabulary is no set of merges")
        out, bytes_of = [], self.v.bytes_of
        while n:
            token = last[data[:n]]
            out.append(token)
            n -= len(bytes_of[token])
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.v.ranks.get(data)
        short = len(data) <= _CACHE_PIECE_BYTES
        ids = [whole] if whole is not None else self._ids(data) if short else Prefixes(self.v, data).ids()
        made = array("I", ids).tobytes()
        if short:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = made
        return made


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.v = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(self.v)
        self.table = [self.v.bytes_of.get(i, b"") for i in range(max(self.v.bytes_of) + 1)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.table.__getitem__, numbers))


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row."""
    # a vocabulary has a fixed size, whatever the tables hold
    sent, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), uuid.uuid4().hex

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        codec = worker_state(key, lambda: Codec(*sent.value))
        n, encoded, decoded = [], [], []
        for text in texts:
            ids = codec.encode(text.decode("utf-8", "replace"))
            n.append(len(ids) // 4)
            encoded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
