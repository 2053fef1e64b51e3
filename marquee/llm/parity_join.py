"""N-gram Jaccard join by parity sketches.

Every shingle of a document toggles one bit of a wide sketch, so the Hamming distance of
two sketches is at most the size of the sets' symmetric difference. For the threshold and
a band of set sizes that difference has a largest value d; the sketch is cut into parts so
that more of them must agree than can agree by being nearly empty (pigeonhole). Documents
meet in a bucket per (band, part, content of the part). Inside a bucket folded 1,024-bit
sketches are compared, and the documents that pass are verified on their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.components import connected_components
from marquee.llm.held import tidy
from marquee.llm.streams import column, dealt, group_bounds, keyed_groups
from marquee.runtime import passing, staged

SKETCH_WORDS = 16       # 64-bit words of the folded sketch
FEW = 2                 # a part with fewer shingles than this says too little to be a key
BLOCK_DOCS = 512        # documents, and
BLOCK_SHINGLES = 1 << 22  # shingles of one block in a verification task
CHUNK_BYTES = 1 << 20   # of texts shingled together
RUN_BYTES = 1 << 20     # packed text of small families verified together
SKETCHED = 64           # texts whose sketches are made together
WIDEST = 1 << 16        # bits of the widest sketch
HUBS = 8                # about so many members of a large family visit all its blocks


def largest_difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes a and b."""
    need = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * need


@lru_cache(maxsize=4)
def bands(percent: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and for each band its parts and how many may be skipped.

    A pair belongs to the band of its smaller set; the larger one has at most 100/percent
    of its size.
    """
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, low[-1] * 100 // percent))
    low = np.array(low, np.int64)
    small = low[1:] - 1
    most = np.empty(len(small), np.int64)
    for i, s in enumerate(small):  # the bound can dip by one between neighbours
        a = np.arange(max(low[i], s - 200), s + 1)
        most[i] = max(largest_difference(a, a * 100 // percent, percent).max(),
                      largest_difference(a, np.maximum(a, a * 100 // percent - 1), percent).max())
    skip = np.where(most > 3, most * 9 // 100 + 1, 0)
    return low, most + 1 + skip, skip


def _keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Bucket keys of one document from its sorted distinct shingle hashes."""
    low, parts, skip = bands(percent)
    n, out = len(values), []
    own = int(np.searchsorted(low, n, "right")) - 1
    code = T.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    for band in range(own, -1, -1):
        if (low[band + 1] - 1) * 100 < percent * n:
            break
        p = int(parts[band])
        part = ((values >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(start, n))
        print_of = np.bitwise_xor.reduceat(code, start)
        part = part[start]
        poor = p - len(part) + int((size < FEW).sum())
        if poor > skip[band]:  # too many poor parts to leave out: all count, empty ones too
            full = np.zeros(p, np.uint64)
            full[part.astype(np.int64)] = print_of
            part, print_of = np.arange(p, dtype=np.uint64), full
        else:
            part, print_of = part[size >= FEW], print_of[size >= FEW]
        out.append(T.mix(print_of + T.mix(part * np.uint64(4096) + np.uint64(band + 1))))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, offsets) of each chunk of a batch."""
    for chunk in T.chunks(batch.column(1), CHUNK_BYTES):
        found = T.words(chunk)
        rows, values = T.shingles(T.word_hashes(chunk, found), found, size)
        values, bounds = T.distinct_per_text(rows, values, len(found.count))
        yield chunk.first, values, bounds


def _sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    bit = (T.mix(values + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(54)).astype(np.int64)
    flat = np.repeat(np.arange(n), np.diff(bounds)) * (64 * SKETCH_WORDS) + bit
    odd = (np.bincount(flat, minlength=n * 64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, -1), axis=1)


def _summaries(size: int):
    def run(batches):
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, values, bounds in _sets(batch, size):
                n = np.diff(bounds)
                sums = [np.append(np.uint64(0), np.cumsum(v, dtype=np.uint64)) for v in (T.mix(values), T.mix(~values))]
                at = slice(first, first + len(n))
                for lo in range(0, len(n), 1024):
                    part = bounds[lo:lo + 1025]
                    prints = _sketches(values[part[0]:part[-1]], part - part[0])
                    k = slice(lo, lo + len(part) - 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[at][k]), pa.array(n[k]),
                        *[pa.array((s[bounds[1:]] - s[bounds[:-1]])[k].view(np.int64)) for s in sums],
                        pa.array([p.tobytes() for p in prints], pa.binary()),
                    ], ["doc_id", "n", "d1", "d2", "sketch"])
    return run


def _postings(size: int, percent: int):
    def run(batches):
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, values, bounds in _sets(batch, size):
                rows, keys, held = [], [], 0
                for i in np.flatnonzero(np.diff(bounds)):
                    keys.append(_keys(values[bounds[i]:bounds[i + 1]], percent))
                    rows.append(np.full(len(keys[-1]), ids[first + i]))
                    held += len(keys[-1])
                    if held > 1 << 17 or i == len(bounds) - 2:
                        yield _posting_batch(keys, rows)
                        rows, keys, held = [], [], 0
                if keys:
                    yield _posting_batch(keys, rows)
    return run


def _posting_batch(keys, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows))], ["key", "doc_id"])


def _shared(batches):
    """Postings of buckets with more than one document, from a stream sorted by key."""
    for table in keyed_groups(batches, ["key"]):
        size = np.diff(bounds := group_bounds(table, ["key"]))
        many = np.repeat(size > 1, size)
        if many.any():
            for b in pa.Table.from_arrays([c for c in table.columns], names=table.column_names).filter(pa.array(many)).to_batches():
                yield b


def _close(sketches: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose size and sketch allow a link with document i."""
    lo, hi = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    others, lo, hi = (x[percent * hi <= 100 * lo] for x in (others, lo, hi))
    apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
    return others[apart <= largest_difference(lo, hi, percent)]


def _bucket_links(percent: int):
    """A spanning forest of each bucket's documents whose sketches are close enough."""
    def run(batches):
        for table in keyed_groups(batches, ["key"]):
            bounds = group_bounds(table, ["key"])
            ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            lead = np.repeat(bounds[:-1], np.diff(bounds))
            apart = np.bitwise_count(sketches ^ sketches[lead]).sum(axis=1, dtype=np.int64)
            lo, hi = np.minimum(n, n[lead]), np.maximum(n, n[lead])
            near = (percent * hi <= 100 * lo) & (apart <= largest_difference(lo, hi, percent))
            far = np.add.reduceat(~near, bounds[:-1]) > 0
            star = np.flatnonzero(near & ~np.repeat(far, np.diff(bounds)))
            edges = [np.stack([ids[star], ids[lead[star]]], axis=1)]
            for lo, hi in zip(bounds[:-1][far], bounds[1:][far]):
                left = np.arange(lo, hi)
                while len(left) > 1:  # grow one tree after another
                    grown, left = [left[0]], left[1:]
                    while grown and len(left):
                        i = grown.pop()
                        near = _close(sketches, n, i, left, percent)
                        edges.append(np.stack([ids[near], np.full(len(near), ids[i])], axis=1))
                        grown.extend(near)
                        left = left[~np.isin(left, near, assume_unique=True)]
            edges = np.unique(np.concatenate(edges), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])
    return run


def _packed_texts(batches):
    """Texts compressed, which is far less to shuffle than their shingle sets."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = column(batch, "doc_id")
        for chunk in T.chunks(batch.column(batch.schema.get_field_index("text")), CHUNK_BYTES):
            n = len(chunk.bounds) - 1
            packed = [squeeze.compress(chunk.data[lo:hi].tobytes()) for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[chunk.first:chunk.first + n]), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _unpacked(packed: pa.ChunkedArray, open_text: zstandard.ZstdDecompressor) -> Iterator[list[bytes]]:
    """Texts, a bounded number of bytes at a time (a longer text alone)."""
    held, size = [], 0
    for part in packed.chunks:
        for i in range(len(part)):
            held.append(open_text.decompress(part[i].as_buffer()))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _unpacked_sets(packed: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, one text after another, and their offsets."""
    values, ends, at = [], [np.zeros(1, np.int64)], 0
    for texts in _unpacked(packed, zstandard.ZstdDecompressor()):
        own = pa.array(texts, pa.large_binary())
        for _, inner, bounds in _sets(pa.RecordBatch.from_arrays([own, own], ["id", "text"]), size):
            values.append(inner)
            ends.append(bounds[1:] + at)
            at += len(inner)
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(ends)


def _verified(size: int, percent: int):
    """A spanning forest of the true links of each block pair of a family."""
    keys = ["family", "b1", "b2"]

    def run(batches):
        for table in keyed_groups(batches, keys):
            bounds = group_bounds(table, keys)
            size_before = np.append(0, np.cumsum(pc.binary_length(table.column("packed")).to_numpy().astype(np.int64)))
            at = 0
            while at < len(bounds) - 1:  # as many groups at a time as have about a megabyte of packed text
                to = max(at + 1, int(np.searchsorted(size_before[bounds], size_before[bounds[at]] + RUN_BYTES, "right")) - 1)
                links = _true_links(table.slice(int(bounds[at]), int(bounds[to] - bounds[at])), bounds[at:to + 1] - bounds[at], size, percent)
                if links:
                    a, b = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                at = to
    return run


def _true_links(table: pa.Table, bounds: np.ndarray, size: int, percent: int) -> list[tuple[int, int]]:
    """Links of each group that join different known components (``comp``), a forest of them."""
    values, offsets = _unpacked_sets(table.column("packed"), size)
    ids, block, comp = (table.column(c).to_numpy() for c in ("doc_id", "block", "comp"))
    first, second = table.column("b1").to_numpy(), table.column("b2").to_numpy()
    n = np.diff(offsets)
    sketches = np.concatenate([_sketches(values[part[0]:part[-1]], part - part[0]) for lo in range(0, len(n), SKETCHED)
                               for part in [offsets[lo:lo + SKETCHED + 1]]]).view(np.uint64)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        tree = np.unique(comp[lo:hi], return_inverse=True)[1]
        for i in range(lo, hi - 1):
            others = i + 1 + np.flatnonzero(tree[i + 1 - lo:] != tree[i - lo])
            if first[lo] != second[lo]:
                others = others[block[others] != block[i]]
            mine = values[offsets[i]:offsets[i + 1]]
            for j in _close(sketches, n, i, others, percent):
                if tree[i - lo] == tree[j - lo]:
                    continue
                theirs = values[offsets[j]:offsets[j + 1]]
                at = np.searchsorted(theirs, mine)
                both = int((theirs[np.minimum(at, len(theirs) - 1)] == mine).sum())
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    tree[tree == tree[j - lo]] = tree[i - lo]
                    out.append((ids[i], ids[j]))
    return out


def _wide(values: np.ndarray) -> np.ndarray:
    """A parity sketch of a text with at least two bits per shingle, up to ``WIDEST``.

    Folding it in half, by XOR, gives the sketch of half the width.
    """
    width = min(WIDEST, max(64 * SKETCH_WORDS, 1 << int(2 * len(values)).bit_length()))
    bit = (T.mix(values + np.uint64(0x9FB21C651E98DF25)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def _widely_sketched(size: int):
    """Wide sketches and sizes beside the packed texts."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("packed")
            values, offsets = _unpacked_sets(pa.chunked_array([batch.column(at)]), size)
            wide = [_wide(values[lo:hi]).tobytes() for lo, hi in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(at), pa.array(np.diff(offsets)), pa.array(wide, pa.binary())],
                ["doc_id", "packed", "n", "wide"])
    return run


def _candidates(percent: int):
    """The documents of each block pair that may link with one of another known component there, by their wide sketches."""
    keys = ["family", "b1", "b2"]

    def run(batches):
        for table in keyed_groups(batches, keys):
            bounds = group_bounds(table, keys)
            ids, block, comp, n = (table.column(c).to_numpy() for c in ("doc_id", "block", "comp", "n"))
            columns = [table.column(k).to_numpy() for k in keys]
            sketches = [np.frombuffer(x.as_buffer(), np.uint64) for part in table.column("wide").chunks for x in part]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                across = columns[1][lo] != columns[2][lo]
                found = _may_link(sketches[lo:hi], n[lo:hi], comp[lo:hi], block[lo:hi] if across else np.arange(hi - lo), percent)
                if found.any():
                    named = np.unique(ids[lo:hi][found])
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(np.full(len(named), c[lo])) for c in columns], pa.array(named)], [*keys, "doc_id"])
    return run


def _may_link(sketches: list[np.ndarray], n: np.ndarray, comp: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Which documents have another one of another component and block whose size and sketch allow a link."""
    found, widths = np.zeros(len(n), bool), np.array([len(x) for x in sketches])
    for width in np.unique(widths):  # the pairs whose narrower sketch has this width
        rows = np.flatnonzero(widths >= width)
        folded = np.stack([np.bitwise_xor.reduce(sketches[i].reshape(-1, width), axis=0) for i in rows])
        for i in np.flatnonzero(widths[rows] == width):
            mine = rows[i]
            others = (widths[rows] > width) | (np.arange(len(rows)) > i)
            others &= (comp[rows] != comp[mine]) & (block[rows] != block[mine])
            lo, hi = np.minimum(n[mine], n[rows]), np.maximum(n[mine], n[rows])
            others = np.flatnonzero(others & (percent * hi <= 100 * lo))
            for at in range(0, len(others), SKETCHED):
                some = others[at:at + SKETCHED]
                apart = np.bitwise_count(folded[some] ^ folded[i]).sum(axis=1, dtype=np.int64)
                close = some[apart <= largest_difference(lo[some], hi[some], percent)]
                found[rows[close]] = True
                found[mine] |= len(close) > 0
    return found


def _blocks(docs: str, shingles: str):
    """Blocks that hold so many documents and shingles."""
    return F.greatest(F.lit(1), F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _family_links(families: DataFrame, heads: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links that span the true components of each family.

    A family is cut into blocks. First each block is verified alone, together with a few
    hubs that visit every block of their family, so each text travels once. That settles a
    family whose members all come out linked. In the others the largest component stays
    apart: its blocks meet only the blocks of the remaining members, which also meet each
    other, and pairs known to be linked are not compared again. Wide sketches meet first, and
    a text travels only to the block pairs where its sketch allows a link.
    """
    def verified(spread: DataFrame) -> DataFrame:
        return dealt(spread, ["family", "b1", "b2"], ["doc_id"]).mapInArrow(tidy(_verified(size, percent)), "a long, b long")

    members = families.join(heads.select("doc_id", "n"), "doc_id")
    shape = (members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
             .withColumn("blocks", _blocks("docs", "shingles"))
             .withColumn("rare", F.greatest(F.ceil(F.col("docs") / HUBS), F.ceil(4 * F.col("shingles") / BLOCK_SHINGLES))))
    shape = staged(shape, "parity-shapes")
    hub = (F.col("doc_id") == F.col("family")) | (F.expr("pmod(xxhash64(doc_id, 1), rare)") == 0)
    placed = (families.join(shape, "family").withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
              .join(texts, "doc_id")
              .withColumn("b1", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))))
    first = staged(verified(placed.select("family", "b1", F.col("b1").alias("b2"), "block", "doc_id",
                                          F.col("doc_id").alias("comp"), "packed")), "parity-links")

    known = connected_components(first).select(F.col("node").alias("doc_id"), "component")
    labelled = (members.join(shape.where("blocks > 1").select("family"), "family").join(known, "doc_id", "left")
                .select("doc_id", "family", "n", F.coalesce("component", "doc_id").alias("comp")))
    parts = labelled.groupBy("family", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    size_of = F.struct("docs", "comp")
    split = (parts.groupBy("family").agg(
        F.count("*").alias("pieces"), F.max_by("comp", size_of).alias("main"), F.max("docs").alias("main_docs"),
        F.max_by("shingles", size_of).alias("main_shingles"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"))
        .where("pieces > 1")
        .withColumns({"rest_docs": F.expr("docs - main_docs"), "rest_shingles": F.expr("shingles - main_shingles")})
        .select("family", "main", _blocks("main_docs", "main_shingles").alias("p"), _blocks("rest_docs", "rest_shingles").alias("q")))
    left = staged(labelled.join(split, "family").select("doc_id", "family", "comp", (F.col("comp") == F.col("main")).alias("in_main"), "p", "q"),
                  "parity-open")
    if left.isEmpty():
        return first
    own = F.expr("cast(if(in_main, pmod(xxhash64(doc_id), p), p + pmod(xxhash64(doc_id), q)) as int)")
    meets = F.expr("explode(sequence(if(in_main, p, 0), p + q - 1))")
    opened = staged(left.select("doc_id").join(texts, "doc_id").mapInArrow(
        tidy(_widely_sketched(size)), "doc_id long, packed binary, n long, wide binary"), "parity-wide")
    spread = left.withColumn("block", own).join(opened.select("doc_id", "n", "wide"), "doc_id").withColumn("other", meets).select(
        "family", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
        "block", "doc_id", "comp", "n", "wide")
    chosen = staged(dealt(spread, ["family", "b1", "b2"], ["doc_id"]).mapInArrow(
        tidy(_candidates(percent)), "family long, b1 int, b2 int, doc_id long"), "parity-candidates")
    members = left.select("family", "doc_id", "comp", own.alias("block"))
    return first.unionByName(verified(chosen.join(members, ["family", "doc_id"]).join(opened.select("doc_id", "packed"), "doc_id").select(
        "family", "b1", "b2", "block", "doc_id", "comp", "packed")))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: groups of documents linked by Jaccard similarity.

    Two documents link when ``100 * intersection >= percent * union`` of their distinct
    ``size``-word shingles (A-Z lower-cased); a shorter text is one shingle of all its words.
    Null, empty and blank texts have no shingles and link with nothing. No pair is lost:
    neither buckets nor families are capped. Equal sets are represented by their smallest id.
    Rows with a null id or with an id that occurs more than once keep one row each; rows
    that share an id are taken as one document holding any of their texts' links.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    with passing(docs.sparkSession) as kept:
        sums, links = _jaccard_links(named, size, percent)
        groups = connected_components(links)
        found = kept(sums.select("doc_id", F.col("n").alias("n_shingles"))
                     .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                     .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "parity-groups")
    return found.unionByName(docs.where("doc_id is null").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _jaccard_links(named: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, ...) per text and (a, b) links that span the groups, from stage tables."""
    sums = staged(named.mapInArrow(tidy(_summaries(size)), "doc_id long, n long, d1 long, d2 long, sketch binary"), "parity")
    copies = sums.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    same = staged(sums.where("n > 0").join(copies, ["d1", "d2", "n"]).select("doc_id", "rep", "n", "sketch"), "parity-reps")
    heads = same.where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch")
    with passing(named.sparkSession) as kept:
        postings = dealt(named.mapInArrow(tidy(_postings(size, percent)), "key long, doc_id long"), ["key"], ["doc_id"])
        shared = staged(postings.mapInArrow(tidy(_shared), "key long, doc_id long"), "parity-keys")
        met = dealt(shared.join(heads, "doc_id").select("key", "doc_id", "n", "sketch"), ["key"], ["n", "doc_id"])
        near = met.mapInArrow(tidy(_bucket_links(percent)), "a long, b long")
        families = kept(connected_components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("family")),
                        "parity-families")

    texts = named.mapInArrow(tidy(_packed_texts), "doc_id long, packed binary")
    true = _family_links(families, heads, texts, size, percent)
    return sums, true.unionByName(same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
