"""Token counts of a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; the best score up to a place and the number of pieces of that best
path are all that is carried, no back pointers and no ids. The tie rules are
those of the public unigram tokenizers: candidates are compared in the order
of their start, a later one must be strictly better; a character without a
piece of its own may be an unknown piece at the lowest score less
``UNKNOWN_PENALTY``; adjacent unknown characters fuse, and become one piece for
each of their bytes if the vocabulary has the byte pieces.

Texts are prepared as the vocabulary's tokenizer does: a word mark in front
and for every space. No piece holds a mark behind another character, so the
best path of a text is that of its stretches that begin with marks, each
solved alone and kept in a bounded cache.

Null texts are empty: no piece, score 0. Rows that repeat a ``doc_id`` each
get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corvida.llm.common import map_texts, worker_state

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_STRETCHES = 300_000
_CACHE_CHARS = 64
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, control and byte pieces included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Unigram:
    """Best score and piece count of texts; ``specials`` are pieces that no text is made of."""

    def __init__(self, pieces: list[tuple[str, float]], specials: tuple[str, ...] = ("<unk>", "<s>", "</s>")):
        ordinary = {p: s for p, s in pieces if p and p not in specials and not _BYTE.fullmatch(p)}
        self.lowest = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = sum(bool(_BYTE.fullmatch(p)) for p, _ in pieces) == 256
        self.cuts = not any(MARK in p.lstrip(MARK) for p in ordinary)
        self.automaton = ahocorasick.Automaton()
        for p, s in ordinary.items():
            self.automaton.add_word(p, (len(p), s))
        if ordinary:
            self.automaton.make_automaton()
        self.empty = not ordinary
        self.cache: dict[str, tuple[float, int]] = {}

    def stretch(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a stretch."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, piece in self.automaton.iter(text):
                ending[end].append(piece)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        lowest, by_bytes = self.lowest, self.by_bytes
        for end in range(1, n + 1):
            top, pieces, fused, single = None, 0, False, False
            # longest first is the earliest start first
            for length, score in sorted(ending[end - 1], reverse=True):
                single = single or length == 1
                if top is None or best[end - length] + score > top:
                    top, pieces = best[end - length] + score, count[end - length] + 1
            if not single and (top is None or best[end - 1] + lowest > top):
                top, fused = best[end - 1] + lowest, True
                if by_bytes:
                    pieces = count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
                else:
                    pieces = count[end - 1] + (not unknown[end - 1])
            best[end], count[end], unknown[end] = top, pieces, fused
        return best[n], count[n]

    def text(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a whole text."""
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        stretches = _STRETCH.findall(marked) if self.cuts else [marked]
        score, pieces, cache = 0.0, 0, self.cache
        for s in stretches:
            got = cache.get(s)
            if got is None:
                got = self.stretch(s)
                if len(s) <= _CACHE_CHARS:
                    if len(cache) >= CACHE_STRETCHES:
                        cache.clear()
                    cache[s] = got
            score += got[0]
            pieces += got[1]
        return score, pieces


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens, best_score`` for every row."""
    # a vocabulary has a fixed size, whatever the tables hold
    sent, key = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        model = worker_state(key, lambda: Unigram(sent.value))
        done = [model.text(t.decode("utf-8", "replace")) for t in texts]
        return {"n_tokens": pa.array([n for _, n in done], pa.int64()), "best_score": pa.array([s for s, _ in done], pa.float64())}

    return map_texts(docs, run, "n_tokens long, best_score double")
