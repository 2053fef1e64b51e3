"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces inside a word; dynamic programming
over its positions carries the best score and the number of pieces of the best path, and
never builds the pieces. Ties go to the longer last piece, as in the unigram tokenizers:
a later candidate must be strictly better. Positions that no piece covers become one
unknown character, priced ten below the lowest score. Under a vocabulary with byte fallback
an unknown character counts as its UTF-8 bytes; otherwise neighbouring unknowns count once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T

MARK = "▁"       # stands for a space in pieces
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores, in file order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), float(p.get_score(i))) for i in range(p.get_piece_size())
            if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]


def has_byte_pieces(path: str) -> bool:
    """Whether a sentencepiece file has all 256 byte pieces, so that no character is unknown."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return len({p.id_to_piece(i) for i in range(p.get_piece_size()) if p.is_byte(i)}) == 256


class Counter:
    """Best score and piece count of strings under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_word = all(MARK not in piece[1:] or not piece.strip(MARK) for piece, _ in pieces)

    def count(self, s: str) -> tuple[float, int]:
        n = len(s)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for end, (length, score) in self.automaton.iter(s):
            at[end + 1].append((length, score))
            if length == 1:
                single[end] = 1
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        for e in range(1, n + 1):
            value, number, odd = None, 0, 0
            found = at[e]
            if not single[e - 1]:
                found.append((1, None))
            found.sort(key=lambda x: -x[0])
            for length, score in found:
                b = e - length
                v = best[b] + (self.unknown if score is None else score)
                if value is None or v > value:
                    value = v
                    odd = score is None
                    if odd and self.byte_fallback:
                        number = pieces[b] + len(s[b].encode())
                    else:
                        number = pieces[b] + (0 if odd and unknown[b] else 1)
            best[e], pieces[e], unknown[e] = value, number, odd
        return best[n], pieces[n]


class Words(dict):
    """complex(score, pieces) of marked words; forgets everything when it is full."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> complex:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = complex(*self.counter.count(MARK + word.decode("utf-8")))
        return out


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(Counter(read_pieces(path), has_byte_pieces(path)))


def count_text(words: Words, raw: bytes) -> tuple[float, int]:
    """(score, pieces) of one text.

    Runs of white space become one mark, and one mark is put in front. Pieces hold a mark
    only in front, so the best path of a text is the best paths of its marked words. Texts
    that hold the mark itself, or vocabularies with other pieces, are taken whole.
    """
    found = raw.split()
    if not words.counter.by_word or MARK.encode() in raw:
        return words.counter.count("".join(MARK + w.decode("utf-8") for w in found))
    total = sum(map(words.__getitem__, found), 0j)
    return total.real, round(total.imag)


def _counted(path: str):
    def run(batches):
        words = _words(path)
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                got = [count_text(words, chunk.data[lo:hi].tobytes())
                       for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, len(got)), pa.array(np.diff(chunk.bounds)),
                    pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64()),
                ], ["doc_id", "n_bytes", "n_tokens", "score"])
    return run


def unigram_counts(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, score) per row: piece count and score of the best segmentation.

    ``pieces`` is a sentencepiece file that names the vocabulary and its scores; if it has byte
    pieces, a character that no piece covers is as many tokens as it has UTF-8 bytes. Null, empty
    and blank texts have no tokens and score zero; rows are independent of one another, so
    repeated and null ids are kept as they are.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(pieces), "doc_id long, n_bytes long, n_tokens long, score double")
