"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both sides' tokens tile the bytes of a text. Two as-of merges of token starts, keyed by
document, find for each token the other side's token that covers its first byte: one of two
overlapping tokens starts inside the other, so both directions together are all overlaps.
Ends that both sides share cut the text into groups.

Overlaps are kept per chunk of documents as places in the chunk's table of distinct id pairs.
Only those tables are shuffled, to count pairs over the corpus; the counts come back as
sorted arrays in the shared folder that workers map into memory.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.arrays import mapped, write_array
from marquee.llm.files import shared_folder
from marquee.llm.streams import column
from marquee.runtime import staged

CHUNK_BYTES = 1 << 20
SHARD_PAIRS = 1 << 20
LONG = 20_000  # a run of white space that the fast splitter's stack may not hold


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, entries: dict[int, bytes]):
        self.bytes = [b""] * (max(entries) + 1)
        for i, b in entries.items():
            self.bytes[i] = b
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [np.array([f"{i}{mark}".encode() for i in range(len(self.bytes))], object) for mark in (",", "|", ";")]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        place = byte_alphabet()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        entries = {i: bytes(place[c] for c in name) for name, i in spec["model"]["vocab"].items() if i not in added}
        super().__init__(entries | added)
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        self.fast = None  # ranks stand for merges only where ids are in the order of the merges
        if order == sorted(set(order)) and spec["pre_tokenizer"].get("use_regex"):
            self.fast = tiktoken.Encoding("side", pat_str=_split_pattern(), mergeable_ranks={b: i for i, b in entries.items()},
                                          special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(" " + t) for t in texts]

    def _ids(self, text: str) -> list[int]:
        if self.fast is None or (len(text) > LONG and re.search(rf"\s{{{LONG}}}", text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pieces(Side):
    """A sentencepiece model: U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, names = self.model.get_piece_size(), self.model.id_to_piece
        super().__init__({i: bytes([int(names(i)[3:5], 16)]) if self.model.is_byte(i) else names(i).replace("▁", " ").encode()
                          for i in range(n)})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Aligned(NamedTuple):
    """Tokens, groups and overlaps of a run of texts, texts one after another."""

    a: np.ndarray         # ids of side A
    b: np.ndarray
    a_doc: np.ndarray     # text of each token
    b_doc: np.ndarray
    a_group: np.ndarray   # group of each token, counted over the run
    b_group: np.ndarray
    link_a: np.ndarray    # token numbers of every overlap, in the order of texts
    link_b: np.ndarray


def align(a_side: Side, b_side: Side, raw: list[bytes]) -> Aligned:
    """Tokens of the texts, but none for a text that is empty or that a side does not give back as it is."""
    import pandas as pd

    texts = [r.decode("utf-8", "replace") for r in raw]
    sides = [a_side.encode(texts), b_side.encode(texts)]
    good = [len(r) > 0 and x.joined(p) == (want := b" " + r) and y.joined(q) == want
            for r, p, q, x, y in zip(raw, *sides, [a_side] * len(raw), [b_side] * len(raw))]
    ids, docs, ends = [], [], []
    for own, lists in zip((a_side, b_side), sides):
        kept = [x if g else [] for x, g in zip(lists, good)]
        n = np.array([len(x) for x in kept], np.int64)
        ids.append(np.concatenate([np.asarray(x, np.int64) for x in kept]) if kept else np.zeros(0, np.int64))
        docs.append(np.repeat(np.arange(len(n)), n))
        ends.append(np.cumsum(own.lengths[ids[-1]]))
    frames = [pd.DataFrame({"at": e - own.lengths[i], "doc": d, name: np.arange(len(i))})
              for own, i, d, e, name in zip((a_side, b_side), ids, docs, ends, "ab")]
    forth = pd.merge_asof(frames[0], frames[1], on="at", by="doc")
    back = pd.merge_asof(frames[1], frames[0].assign(start=frames[0]["at"]), on="at", by="doc")
    back = back[back["at"] != back["start"]]  # pairs that start together are in both directions
    link_a, link_b, doc = (np.concatenate([forth[c].to_numpy(), back[c].to_numpy()]).astype(np.int64) for c in ("a", "b", "doc"))
    order = np.argsort(doc, kind="stable")
    shared = np.intersect1d(ends[0], ends[1], assume_unique=True)
    groups = [np.searchsorted(shared, e) for e in ends]
    return Aligned(*ids, *docs, *groups, link_a[order], link_b[order])


def group_texts(found: Aligned, a_side: Side, b_side: Side, n: int) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    total = int(found.a_group[-1]) + 1 if len(found.a) else 0
    in_a, in_b = np.bincount(found.a_group, minlength=total), np.bincount(found.b_group, minlength=total)
    a_before, b_before = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    out = np.empty(len(found.a) + len(found.b), object)
    for own, ids, group, place, mark in (
            (a_side, found.a, found.a_group, np.arange(len(found.a)) + b_before[found.a_group], 1),
            (b_side, found.b, found.b_group, np.arange(len(found.b)) + (a_before + in_a)[found.b_group], 2)):
        last = np.append(group[1:] != group[:-1], True)[:len(group)]
        out[place] = own.names[0][ids]
        out[place[last]] = own.names[mark][ids[last]]
    bounds = np.cumsum(np.bincount(found.a_doc, minlength=n) + np.bincount(found.b_doc, minlength=n))
    items = out.tolist()
    return [b"".join(items[lo:hi])[:-1] for lo, hi in zip([0, *bounds[:-1]], bounds)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        for chunk in T.chunks(batch.column(1), CHUNK_BYTES):
            raw = [chunk.data[lo:hi].tobytes() for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:])]
            yield batch.column(0).slice(chunk.first, len(raw)), raw


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its doc_id, both sides' ids, each token's group number, and its overlaps as token numbers.

    (doc_id, a_ids, b_ids, a_groups, b_groups, links_a, links_b). A text that is null or empty,
    or whose tokens do not join to a space and the text, has empty lists. Rows are independent
    of one another: repeated and null ids and an empty table are no special case, and other
    columns are not read.
    """
    names = ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "links_a", "links_b"]

    def run(batches):
        x, y = side(a_path), side(b_path)
        for ids, raw in _rows(batches):
            found, n = align(x, y, raw), len(raw)
            a_at, b_at = (np.searchsorted(d, np.arange(n + 1)) for d in (found.a_doc, found.b_doc))
            link_at = np.searchsorted(found.a_doc[found.link_a], np.arange(n + 1))
            first = np.minimum(a_at[:-1], max(len(found.a) - 1, 0))
            lead = found.a_group[first] if len(found.a) else np.zeros(n, np.int64)
            lists = [(found.a, a_at), (found.b, b_at), (found.a_group - lead[found.a_doc], a_at), (found.b_group - lead[found.b_doc], b_at),
                     (found.link_a - a_at[found.a_doc[found.link_a]], link_at), (found.link_b - b_at[found.b_doc[found.link_b]], link_at)]
            yield pa.RecordBatch.from_arrays([ids, *(T.int_lists(v, at) for v, at in lists)], names)

    kinds = ", ".join(f"{c} array<long>" for c in names[1:])
    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {kinds}")


CHUNKS = ("doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, codes array<long>, counts array<long>, width int, places binary")


def _chunk_rows(a_path: str, b_path: str):
    """One row per chunk of documents: their figures, and overlaps as places in the chunk's table of id pairs."""
    def run(batches):
        x, y = side(a_path), side(b_path)
        for ids, raw in _rows(batches):
            found, n = align(x, y, raw), len(raw)
            code, place, count = np.unique(found.a[found.link_a] << 32 | found.b[found.link_b], return_inverse=True, return_counts=True)
            width = 2 if len(code) <= 1 << 16 else 4
            last = np.append(found.a_group[1:] != found.a_group[:-1], True)[:len(found.a)]
            figures = [np.bincount(d, minlength=n) for d in (
                found.a_doc, found.b_doc, found.a_doc[last], found.a_doc[found.link_a])]
            digests = [sha256(t).hexdigest() if k else "" for t, k in zip(group_texts(found, x, y, n), figures[0])]
            one = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(T.int_lists(f, np.array([0, n])) for f in figures),
                   pa.array([digests]), *(T.int_lists(v, np.array([0, len(code)])) for v in (code, count)),
                   pa.array([width], pa.int32()), pa.array([place.astype(f"<u{width}").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, [c.split()[0] for c in CHUNKS.split(", ")])
    return run


def _write_shards(folder: str):
    """Sorted pair codes and their marked counts as files of bounded size; one row per file."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((column(batch, "code"), column(batch, "marked")))
            size += batch.num_rows
            if size >= SHARD_PAIRS:
                yield _shard(folder, held)
                held, size = [], 0
        if size:
            yield _shard(folder, held)
    return run


def _shard(folder: str, held: list) -> pa.RecordBatch:
    name, (codes, marked) = uuid.uuid4().hex, (np.concatenate(x) for x in zip(*held))
    write_array(folder, f"{name}.code", codes.astype("<i8"))
    write_array(folder, f"{name}.count", marked.astype("<i8"))
    return pa.RecordBatch.from_arrays([pa.array([int(codes[0])]), pa.array([name])], ["first", "name"])


def _summed(folder: str, shards: list[tuple[int, str]]):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    firsts = np.array([f for f, _ in shards], np.int64)

    def run(batches):
        for batch in batches:
            get = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for k in range(batch.num_rows):
                codes = get["codes"][k].values.to_numpy()
                marked = np.empty(len(codes), np.int64)
                at = np.append(np.searchsorted(codes, firsts), len(codes))
                for (_, name), lo, hi in zip(shards, at[:-1], at[1:]):
                    if hi > lo:
                        held = mapped(folder, f"{name}.code", "<i8")
                        marked[lo:hi] = mapped(folder, f"{name}.count", "<i8")[np.searchsorted(held, codes[lo:hi])]
                width = get["width"][k].as_py()
                each = marked[np.frombuffer(get["places"][k].as_py(), f"<u{width}")]
                n_links = get["n_links"][k].values.to_numpy()
                end = np.cumsum(n_links)
                sums = [np.append(0, np.cumsum(v)) for v in (each & 1, each >> 1)]
                n_best, count_sum = (s[end] - s[end - n_links] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [get["doc_ids"][k].values, *(get[c][k].values for c in names[1:4]), pa.array(n_links), pa.array(n_best),
                     pa.array(count_sum), get["groups_sha256"][k].values], names)
    return run


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its tokens, groups and overlaps, how common its overlapping id pairs are in the corpus, and a digest of its groups.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). A pair's count is
    the number of overlaps of the whole table that hold it; ``count_sum`` adds it up over a
    document's overlaps, ``n_best`` counts those whose pair no other pair of its B id exceeds
    (ties count). A text that is null or empty, or whose tokens do not join to a space and the
    text, has zeros and the digest ''. Rows that repeat an id are documents of their own, a
    null id stays null, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    chunks = staged(_texts(docs, id_col, text_col).mapInArrow(_chunk_rows(a_path, b_path), CHUNKS), "aligned")
    pairs = staged(chunks.select(F.inline(F.arrays_zip("codes", "counts"))).groupBy(F.col("codes").alias("code"))
                   .agg(F.sum("counts").alias("n")), "aligned-pairs")
    b = F.col("code").bitwiseAND((1 << 32) - 1).alias("b")
    best = pairs.groupBy(b).agg(F.max("n").alias("most"))
    marked = pairs.select("code", "n", b).join(best, "b").select(
        "code", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("bigint")).alias("marked"))
    folder = shared_folder(spark, "aligned-counts")
    shards = (marked.repartitionByRange("code").sortWithinPartitions("code")
              .mapInArrow(_write_shards(folder), "first long, name string").collect())  # one row per million pairs
    return chunks.mapInArrow(_summed(folder, sorted((r.first, r.name) for r in shards)),
                             "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
