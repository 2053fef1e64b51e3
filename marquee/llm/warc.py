"""WARC archives of pages with a two-level capture index.

Tasks write each record as a gzip member of its own into archives in the shared folder. The
captures are sorted by reversed-host URL key into compressed blocks of lines, several blocks
to a shard; a sparse directory per shard holds each block's first key. A query is located by
binary search over the shards' first keys and then over one directory, its block is read by
one range read and searched, and the records it names are read by range reads of the archives.
"""

from __future__ import annotations

import base64
import bisect
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.files import shared_folder, store_of
from marquee.runtime import staged

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROLL_BYTES = 256 << 20   # compressed bytes of an archive before the next one is begun
BLOCK_LINES = 1024       # captures of one compressed index block
SHARD_BLOCKS = 1024      # blocks of one index shard
TASK_BYTES = 64 << 20    # compressed bytes of records read by a task
RUN_BYTES = 4 << 20      # neighbouring records are read together up to this size
HOT_SHARE = 1000         # a payload with more than this part of all repeated rows is matched by broadcast

NO_ID = "none"


def url_key(url: Column) -> Column:
    """``http://www.Example.com:80/a?b`` as ``com,example,www)/a?b``: the captures of a host lie together.

    Scheme, user, port and fragment are left out, the host is lower-cased. Null and
    text without a host sort under an empty host.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``digest`` (hex SHA-1 of the payload) and ``refers_to``, the largest id with an equal payload where that is another.

    ``pages`` is (page_id, url, payload). Groups are combined before they are shuffled. A
    payload that many rows share never meets in one task: the at most ``HOT_SHARE`` payloads
    that hold more than their part of all repeated rows are matched by a broadcast.
    """
    rows = pages.withColumn("digest", F.sha1("payload"))
    groups = staged(
        rows.where(F.length("payload") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("master"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    bound = (groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / HOT_SHARE
    hot = groups.where(F.col("n") > bound).select("digest", F.col("master").alias("hot_master"))
    cold = groups.where(F.col("n") <= bound).select(F.col("digest").alias("met"), F.col("master").alias("cold_master"))
    found = rows.join(F.broadcast(hot), "digest", "left")  # fewer than HOT_SHARE rows
    # rows that are settled take a key of their own, so that they do not pile up in the second join
    own = F.when(F.col("hot_master").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    master = F.coalesce("hot_master", "cold_master")
    return (found.withColumn("met", own).join(cold, "met", "left")
            .select("page_id", "url", "payload", "digest",
                    F.when(~master.eqNullSafe(F.col("page_id")), master).alias("refers_to")))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    own = name.strip().removeprefix("<urn:page:").removesuffix(">")
    return None if own == NO_ID else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response or revisit record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + json.dumps(url)[1:-1])  # no line breaks in a header
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); header names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"no WARC record: {version[:40]!r}")
    warc = _headers(lines)
    body = rest[:int(warc["content-length"])]
    if len(rest) != len(body) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is not what its header says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, _headers(http.decode().split("\r\n")[1:]), payload


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def gzip_member(data: bytes, level: int = 6) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


CAPTURES = "key string, page_id long, url string, digest string, record_type string, file string, offset long, length long"
_CAPTURES = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in CAPTURES.split(", "))])


def _archive(folder: str, date: str, roll: int):
    """Writes a task's records; an attempt's files have names of their own, and only a finished attempt's captures count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(folder)
        out, name, size = None, None, 0
        for batch in batches:
            done = []
            for row in _rows(batch):
                if out is None:
                    store.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    out.write(lead := gzip_member(info.encode()))
                    size = len(lead)
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                member = gzip_member(record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"], date))
                out.write(member)
                kind = "response" if row["refers_to"] is None else "revisit"
                done.append((row["key"], row["page_id"], row["url"], digest, kind, name, size, len(member)))
                size += len(member)
                if size >= roll:
                    out = out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CAPTURES)] if done else
                                             [pa.array([], f.type) for f in _CAPTURES], schema=_CAPTURES)
        if out is not None:
            out.close()
    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one after another, so that only one payload at a time is a Python object."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}


@dataclass
class Archive:
    folder: str
    captures: DataFrame     # one row per record
    bytes: int              # of all records
    shards: list[tuple]     # (first key, first page id, shard) in order, one per up to a million captures


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL_BYTES,
                  block_lines: int = BLOCK_LINES, shard_blocks: int = SHARD_BLOCKS) -> Archive:
    """Writes one record per page into WARC archives in the shared folder, and their capture index.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id
    is a response and the others are revisits of it. Pages that share that largest id as well
    are all responses; a null id is below every other, and pages of a payload that has only
    null ids are all responses. A null payload is the empty one, a null URL has no target
    header. An empty table gives an archive of no files. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    folder = shared_folder(spark, "warc")
    told = with_revisits(rows, least_bytes).withColumn("key", url_key(F.col("url")))
    captures = staged(told.mapInArrow(_archive(folder, date, roll), CAPTURES), "captures")
    order = ["key", "page_id", "file", "offset"]
    shards = (captures.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_index(folder, block_lines, shard_blocks), "key string, page_id long, shard string").collect())  # one row per shard
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return Archive(folder, captures, size, sorted((r.key, _rank(r.page_id), r.shard) for r in shards))


def _rank(page_id: int | None) -> int:
    """Ids as the index sorts them: null first."""
    return -(1 << 63) - 1 if page_id is None else page_id


def _line_key(line: list) -> tuple[bytes, int]:
    return line[0].encode(), _rank(line[1])


def _index(folder: str, block_lines: int, shard_blocks: int):
    """Shards of compressed blocks from a sorted stream of captures, each with its directory."""
    def run(batches):
        store, at = store_of(folder)
        lines, blocks, out, name, size = [], [], None, None, 0

        def end_shard():
            nonlocal out, blocks, size
            out.close()
            with store.open_output_stream(f"{at}/{name}.dir", compression=None) as d:
                d.write(gzip_member(json.dumps(blocks).encode()))
            first = blocks[0]
            out, blocks, size = None, [], 0
            return pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])],
                                              ["key", "page_id", "shard"])

        def end_block():
            nonlocal out, name, lines, size
            if out is None:
                store.create_dir(at, recursive=True)
                name = uuid.uuid4().hex
                out = store.open_output_stream(f"{at}/{name}.idx", compression=None)
            data = gzip_member("\n".join(lines).encode())
            out.write(data)
            blocks.append([*json.loads(lines[0])[:2], size, len(data)])
            lines, size = [], size + len(data)

        for batch in batches:
            for row in _rows(batch):
                lines.append(json.dumps(list(row.values())))
                if len(lines) == block_lines:
                    end_block()
                    if len(blocks) == shard_blocks:
                        yield end_shard()
        if lines:
            end_block()
        if blocks:
            yield end_shard()
    return run


def _read(folder: str, name: str, offset: int = 0, length: int | None = None) -> bytes:
    store, at = store_of(folder)
    with store.open_input_file(f"{at}/{name}") as f:
        f.seek(offset)
        return f.read(length)


@lru_cache(maxsize=4)
def _directory(folder: str, shard: str) -> tuple[list, list]:
    blocks = json.loads(zlib.decompress(_read(folder, f"{shard}.dir"), 31))
    return [_line_key(b) for b in blocks], blocks


def _covering(firsts: list, low: tuple, high: tuple) -> range:
    """Places of a sorted run of first keys whose pieces may hold keys from low to high."""
    return range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high))


def _locate(archive_folder: str, shards: list[tuple]):
    firsts = [(k.encode(), p) for k, p, _ in shards]

    def run(batches):
        for batch in batches:
            out = []
            for row in _rows(batch):
                key = row["key"].encode()
                low, high = ((key, -(1 << 64)), (key, 1 << 64)) if row["any_page"] else ((key, _rank(row["page_id"])),) * 2
                for s in _covering(firsts, low, high):
                    places, blocks = _directory(archive_folder, shards[s][2])
                    out += [(shards[s][2], *blocks[b][2:4], row["key"], row["page_id"], row["any_page"]) for b in _covering(places, low, high)]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["shard", "block", "size", "key", "page_id", "any_page"])
    return run


def _search(folder: str):
    def run(batches):
        held, lines, keys = None, [], []
        for batch in batches:
            out = []
            for row in _rows(batch):
                if (row["shard"], row["block"]) != held:
                    held = row["shard"], row["block"]
                    data = zlib.decompress(_read(folder, f"{row['shard']}.idx", row["block"], row["size"]), 31)
                    lines = [json.loads(x) for x in data.decode().split("\n")]
                    keys = [_line_key(x) for x in lines]
                key = row["key"].encode()
                low, high = ((key, -(1 << 64)), (key, 1 << 64)) if row["any_page"] else ((key, _rank(row["page_id"])),) * 2
                out += lines[bisect.bisect_left(keys, low):bisect.bisect_right(keys, high)]
            cols = list(zip(*out)) or [()] * len(_CAPTURES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CAPTURES)], schema=_CAPTURES)
    return run


def find_captures(archive: Archive, queries: DataFrame) -> DataFrame:
    """Captures of the queried URL keys, by the index alone.

    ``queries`` is (key) for all captures of a key, or (key, page_id) for those of a page. A
    query asked twice counts once. It is cut into one search per block that may hold its
    captures, so a key with very many captures is searched by many tasks.
    """
    exact = "page_id" in queries.columns
    asked = queries.select("key", (F.col("page_id").cast("bigint") if exact else F.lit(None).cast("bigint")).alias("page_id"),
                           F.lit(not exact).alias("any_page")).where(F.col("key").isNotNull()).distinct()
    located = (asked.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
               .mapInArrow(_locate(archive.folder, archive.shards),
                           "shard string, block long, size long, key string, page_id long, any_page boolean"))
    return (located.repartition("shard", "block").sortWithinPartitions("shard", "block", "key", "page_id")
            .mapInArrow(_search(archive.folder), CAPTURES))


RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "payload binary")


def _runs(batches) -> Iterator[list[dict]]:
    """Captures that follow one another in an archive, up to a bounded size."""
    held: list[dict] = []
    for batch in batches:
        for row in _rows(batch):
            if held and (row["file"] != held[0]["file"] or row["offset"] != held[-1]["offset"] + held[-1]["length"]
                         or row["offset"] + row["length"] - held[0]["offset"] > RUN_BYTES):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _records(folder: str):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def run(batches):
        for rows in _runs(batches):
            start = rows[0]["offset"]
            data = _read(folder, rows[0]["file"], start, rows[-1]["offset"] + rows[-1]["length"] - start)
            out = []
            for row in rows:
                raw = zlib.decompress(data[row["offset"] - start:row["offset"] - start + row["length"]], 31)
                warc, http, payload = parse_record(raw)
                kind, told = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                url = warc.get("warc-target-uri")
                if kind == "revisit":
                    size, refers, payload = int(http["content-length"]), page_of(warc["warc-refers-to"]), None
                else:
                    size, refers = len(payload), None
                    if base64.b32encode(sha1(payload).digest()).decode() != told:
                        raise ValueError(f"payload of {warc['warc-record-id']} in {row['file']} is damaged")
                out.append((page_of(warc["warc-record-id"]), None if url is None else json.loads(f'"{url}"'), kind, size, told, refers, payload))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return run


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of captures, by range reads of the archives; neighbours are read together.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload). A
    response's digest is compared with its payload; a revisit has the length and digest of
    the full payload and the response's id, and a null payload. A capture that is given
    twice is read twice.
    """
    spark = captures.sparkSession
    # dealt by the archives' bytes: the rows themselves are few, and would be put into one task
    parts = max(spark.sparkContext.defaultParallelism, -(-archive.bytes // TASK_BYTES))
    return (captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset")
            .sortWithinPartitions("file", "offset").mapInArrow(_records(archive.folder), RECORDS))


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Every page's record after the way through archive and index: written, looked up by URL key and id, and read."""
    archive = write_archive(pages, id_col, url_col, html_col, **options)
    asked = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), F.col(id_col).cast("bigint").alias("page_id"))
    return read_records(archive, find_captures(archive, asked))
