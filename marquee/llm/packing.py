"""Concatenate and cut: token ids laid end to end and cut into fixed windows.

Pass one tokenises each partition, stores the ids with their start inside the partition (or
the piece of a file) and so gives its total. A prefix sum over those totals (one row each) turns
them into global offsets. Pass two cuts each document at the window boundaries; a document
that crosses a boundary gives one record on either side. Tokens are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.held import held, tidy
from marquee.llm.streams import column
from marquee.runtime import staged

CACHE_WORDS = 500_000
CHUNK_BYTES = 1 << 20  # of texts tokenised together
BATCH_WORDS = 64  # words encoded together
CAPITAL_AND_MARK = re.compile(rb"[A-Z][^\x00-\x7f]*[\xcc\xcd]")  # U+0300 to U+037F begin with CC or CD
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


class WordIds(dict):
    """Little-endian ids of a lower-cased word, as bytes; forgets everything when it is full.

    For tokenizers that drop white space and lower-case, the ids of a text are the ids of its
    words one after another. A word that ends in a letter or digit and ASCII marks is those
    two pieces, and a word of letters ends in the only id that carries the word end. Both are
    judged after what the tokenizer does first, composition and lower-casing: some letters
    come out of it with a combining mark at the end, which joins a mark that follows.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        stem, marks = self.parts(word)
        self[word] = ids = self[stem] + self[marks] if marks else self.encode([stem])
        return ids

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(MARKS)
        if not stem or len(stem) == len(word):
            return word, b""
        end = stem[-1:].isalnum() if stem[-1] < 0x80 else settled(stem)[-1:].isalpha()
        return (stem, word[len(stem):]) if end else (word, b"")

    def encode(self, words: list[bytes]) -> bytes:
        ids = self.tokenizer.encode(" ".join(w.decode("utf-8", "replace") for w in words), add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode the new words, many at a time.

        Words are looked up one by one; a set's difference with this class would go through all kept words.
        """
        if len(self) > CACHE_WORDS:
            self.clear()
        new = {self.parts(w)[0] for w in words if w not in self}
        new = [w for w in new if w not in self and (w.isalpha() if w.isascii() else settled(w).isalpha())]
        width = np.dtype(self.dtype).itemsize
        for lo in range(0, len(new), BATCH_WORDS):
            part = new[lo:lo + BATCH_WORDS]
            ids = self.encode(part)
            cut = ((np.flatnonzero(self.last[np.frombuffer(ids, self.dtype)]) + 1) * width).tolist()
            if len(cut) == len(part):  # otherwise this tokenizer marks word ends in another way
                self.update((w, ids[b:e]) for w, b, e in zip(part, [0, *cut[:-1]], cut))


def folded_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, which makes fewer of them, where no combining mark follows a capital.

    The tokenizer composes before it lower-cases, and some capitals compose with a mark that
    the small letter does not, or the other way round.
    """
    return (text if CAPITAL_AND_MARK.search(text) else text.lower()).split()


def settled(word: bytes) -> str:
    """A word as the tokenizer sees it."""
    return unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower()


def _word_ids(path: str) -> WordIds:
    return held(("packing", path), lambda: WordIds(path))


def _tokenised(path: str, end_id: int):
    """Batches of (doc_id, text, file, block); ``file`` and ``block`` name the piece of a file a row is from."""
    def run(batches):
        words = _word_ids(path)
        end, width = np.array([end_id], words.dtype).tobytes(), np.dtype(words.dtype).itemsize
        part, at, row, held = TaskContext.get().partitionId(), 0, 0, None
        for batch in (b for whole in batches for b in _pieces(whole)):
            piece = (batch.column(2)[0].as_py(), batch.column(3)[0].as_py())
            if piece != held:
                at, row, held = 0, 0, piece
            for chunk in T.chunks(batch.column(1), CHUNK_BYTES):
                texts = (chunk.data[lo:hi].tobytes() for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:]))
                marked = (chunk.data == 0xCC).any() or (chunk.data == 0xCD).any()
                found = [folded_words(t) if marked else t.lower().split() for t in texts]
                words.learn(set().union(*found))
                ids = [b"".join(map(words.__getitem__, f)) + end for f in found]
                n = np.array([len(x) // width for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, len(ids)), *(batch.column(i).slice(chunk.first, len(ids)) for i in (2, 3)),
                    pa.array(np.full(len(ids), part, np.int64)),
                    pa.array(np.arange(row, row + len(ids))), pa.array(start), pa.array(n), pa.array(ids, pa.binary()),
                ], ["doc_id", "file", "block", "part", "row", "start", "n", "ids"])
                row += len(ids)
    return run


def _pieces(batch: pa.RecordBatch):
    """The runs of a batch that are from one piece of a file."""
    if not batch.num_rows:
        return
    file, block = batch.column(2).dictionary_encode().indices.to_numpy(), batch.column(3).to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(lo), int(hi - lo))


def _cut(window: int, dtype: np.dtype):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            base, n = column(batch, "base"), column(batch, "n")
            first, last = base // window, (base + n - 1) // window
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(base[doc], seq * window)
            hi = np.minimum((base + n)[doc], (seq + 1) * window)
            start, blobs, sums = lo - base[doc], batch.column(batch.schema.get_field_index("ids")), np.empty(len(doc), np.int64)
            held = -1
            for i, d in enumerate(doc):
                if d != held:
                    ids, held = np.frombuffer(blobs[int(d)].as_py(), dtype).astype("<u4"), d
                sums[i] = zlib.crc32(ids[start[i]:start[i] + hi[i] - lo[i]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, hi - lo, sums, n[doc], seq, lo - seq * window))], names)
    return run


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
              in_file_order: bool = False) -> DataFrame:
    """(doc_id, file, block, part, row, start, n, ids) as a stage table: ``ids`` with ``end_id`` appended.

    ``start`` counts from the beginning of (part, file, block).
    """
    rows = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    none = [F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block")]
    found = docs.select(*rows, *none)
    if in_file_order:
        try:
            found = docs.select(*rows, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        except AnalysisException:
            pass  # not read from files: its partitions are in order
    return staged(found.mapInArrow(tidy(_tokenised(tokenizer, end_id)), "doc_id long, file string, block long, part long, row long, "
                                                                  "start long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", in_file_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; all sequences but the last are full.
    Null and empty texts are the end id alone. Rows that repeat an id are packed as separate
    documents with that id; a null id is kept as null. An empty table gives no rows. Documents
    are laid out in the order they are read, which for files is by size; ``in_file_order`` lays
    out the rows of part files by the files' numbers and keeps the order a sorted table was
    written in. A table that is not read from files keeps the order of its partitions.
    """
    tokens = tokenised(docs, tokenizer, end_id, id_col, text_col, in_file_order)
    dtype = _word_ids(tokenizer).dtype
    piece = ["file", "block", "part"]
    totals = tokens.groupBy(*piece).agg(F.sum("n").alias("total"))
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    before = Window.orderBy(number, *piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*piece, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), piece)  # one row per partition of the input, or piece of its files
    return (placed.select("doc_id", (F.col("start") + F.col("offset")).alias("base"), "n", "ids")
            .mapInArrow(tidy(_cut(window, dtype)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                             "sequence_id long, offset long"))
