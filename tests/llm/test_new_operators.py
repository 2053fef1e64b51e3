"""Fill-in-middle, cross-tokenizer alignment and WARC against plain Python."""

import base64
import random
import re
from collections import Counter
from hashlib import sha1, sha256

import pytest
from pyspark.sql import functions as F

from marquee.llm import alignment, fill_middle, warc
from marquee.llm.queries import BYTE_LEVEL, PIECES

TEXTS = [
    None, "", " ", "\n", "\n\n\n", "one line", "one\ntwo\nthree", "one\ntwo\nthree\n", "has <P> inside\nand more", "<M>", "a\r\nb\x0bc\n",
    "  two  spaces\n\nend ", "<|endoftext|> <s> é日本", "x" * 900, "a▁b", "ﬁne", "👍🏽 \x00 z ङ़", "ok\tb c d​ z",
    "the same line\n" * 40, "the same line\n" * 40, "The cat's whiskers, naïve café – 12345 67", "\n".join(f"line {i} of a long text" for i in range(900)),
    " " * 30_000 + "after a long run of blanks",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "repeated id\nx"), (3, "repeated id\nx"), (None, "no id\nat all\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"n": F.lit("clash"), "output": F.lit(1), "code": F.lit(2), "doc_ids": F.lit(3)})


def by_row(rows, *key):
    return Counter(tuple(r[k] for k in key) for r in rows)


def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    name = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[i * 8:i * 8 + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(table):
    found = fill_middle.fill_in_middle(table)
    rows = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, *cut(r.doc_id, r.text), r.text or "") for r in table.collect())
    assert by_row(rows, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back") == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(table.where("false")).count() == 0


def test_fill_in_middle_rate(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n" * 5) for i in range(2000)], "doc_id long, text string")
    forms = Counter(r.form for r in fill_middle.fill_in_middle(docs, rate=50, spm_rate=20).collect())
    assert abs(forms["plain"] - 1000) < 100 and abs(forms["spm"] - 200) < 60 and forms["psm"] > 600


def test_lines_of_long_texts():
    for text, n in (("a\n" * 300_000, 300_000), ("x" * 3_000_000, 1), ("\n" * 200_000 + "y", 200_001)):
        assert len(fill_middle.LINES.fullmatch(text).ends(1)) == n


def spans(side, ids):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(side.bytes[i]), i))
        at = out[-1][1]
    return out


def aligned(text):
    """(A tokens, B tokens, groups, links) by comparing every pair of tokens nearby."""
    x, y = alignment.side(BYTE_LEVEL), alignment.side(PIECES)
    want = b" " + (text or "").encode()
    a = x.exact.encode(want.decode(), add_special_tokens=False).ids
    b = y.model.encode(text or "")
    if not text or x.joined(a) != want or y.joined(b) != want:
        return [], [], "", []
    a, b = spans(x, a), spans(y, b)
    links = [(u[2], v[2]) for u in a for v in b if max(u[0], v[0]) < min(u[1], v[1])]
    groups, lo = [], 0
    for end in sorted({u[1] for u in a} & {v[1] for v in b}):
        groups.append("|".join(",".join(str(u[2]) for u in side if lo < u[1] <= end) for side in (a, b)))
        lo = end
    return a, b, groups, links


def test_alignment_counts_equal_brute_force(table):
    rows = [(r.doc_id, *aligned(r.text)) for r in table.where("length(coalesce(text, '')) < 25000").collect()]
    count = Counter(pair for r in rows for pair in r[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter((i, len(a), len(b), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
                    sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in rows)
    got = alignment.alignment_counts(table.where("length(coalesce(text, '')) < 25000"), BYTE_LEVEL, PIECES).collect()
    assert by_row(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == want
    assert alignment.alignment_counts(table.where("false"), BYTE_LEVEL, PIECES).count() == 0


def test_token_alignment_lists(table):
    x, y = alignment.side(BYTE_LEVEL), alignment.side(PIECES)
    for r in alignment.token_alignment(table, BYTE_LEVEL, PIECES).collect():
        groups = len(set(r.a_groups))
        assert len(r.a_groups) == len(r.a_ids) and len(r.b_groups) == len(r.b_ids) and set(r.b_groups) == set(range(groups))
        for g in range(min(groups, 50)):
            sides = [b"".join(s.bytes[i] for i, k in zip(ids, gs) if k == g) for s, ids, gs in ((x, r.a_ids, r.a_groups), (y, r.b_ids, r.b_groups))]
            assert sides[0] == sides[1]
        a, b = spans(x, r.a_ids), spans(y, r.b_ids)
        assert all(max(a[i][0], b[j][0]) < min(a[i][1], b[j][1]) for i, j in zip(r.links_a, r.links_b))
        assert len(set(zip(r.links_a, r.links_b))) == len(r.links_a) == len(a) + len(b) - groups if a else not r.links_a


def test_fast_splitter_gives_the_files_tokens():
    x, rng = alignment.side(BYTE_LEVEL), random.Random(4)
    assert x.fast is not None
    letters = "abcXYZ 's'll 12 \n\t 　éßक़ิ日本語👍🏽½²Ⅷ_-—.,!?<|>‍\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["x" * 50_000, "\n" * 60_000 + "z"]
    for text, ids in zip(texts, x.encode(texts)):
        assert ids == x.exact.encode(" " + text, add_special_tokens=False).ids


PAGES = [
    (1, "http://b.example.com/x?q=1#frag", "<p>one</p>"), (2, "https://user@A.example.com:8080/", "<p>two</p>"), (3, None, None), (4, "", ""),
    (5, "no scheme", "<p>one</p>"), (6, "http://b.example.com/x?q=1", "<p>one</p>"), (7, "http://b.example.com/x?q=1", "é\r\n\r\nWARC/1.1\r\n"),
    (7, "http://b.example.com/x?q=1", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://c.org/\n\"'", "<p>two</p>"), (None, "http://d.org", "only null ids"),
    (None, "http://d.org", "only null ids"), (9, "http://例え.jp/ü", "x" * 3_000_000),
]


def told(rows, least=0):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, k in rows if (k or "") == (h or "") and j is not None]
        top = max(same) if same and len(raw) >= least else None
        refers = top if top is not None and top != i else None
        out.append((i, len(raw), base64.b32encode(sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return Counter(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archived_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    df = df.withColumns({"key": F.lit("clash"), "payload": F.lit(1), "file": F.lit(2), "digest": F.lit(3), "n": F.lit(4)})
    for options in ({}, {"block_lines": 2, "shard_blocks": 2, "roll": 1000}):
        assert by_row(warc.archived_pages(df, **options).collect(), *COLUMNS) == told(PAGES)
    assert by_row(warc.archived_pages(df, least_bytes=11).collect(), *COLUMNS) == told(PAGES, 11)
    assert warc.archived_pages(df.where("false")).count() == 0


def test_captures_of_a_key(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p", f"page {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    archive = warc.write_archive(df, block_lines=16, shard_blocks=4, roll=20_000)
    assert len(archive.shards) > 10
    asked = spark.createDataFrame([("com,example,h3)/p",), ("com,example,h3)/p",), ("com,example,h9)/p",), (None,)], "key string")
    got = warc.find_captures(archive, asked).collect()
    assert sorted(r.page_id for r in got) == [i for i in range(3000) if i % 7 == 3]
    records = warc.read_records(archive, warc.find_captures(archive, asked)).collect()
    for r in records:
        assert r.refers_to == (None if r.page_id >= 2950 else 2950 + r.page_id % 50)
        assert (r.payload is None) == (r.record_type == "revisit") and r.url == "http://h3.example.com/p"
        assert r.payload is None or bytes(r.payload).decode() == f"page {r.page_id % 50}"


def test_archives_are_read_by_other_tools(spark):
    import gzip

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archive(df)
    files = {r.file for r in archive.captures.select("file").collect()}
    data = b"".join(gzip.decompress(warc._read(archive.folder, f)) for f in files)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) + len(files)


def test_url_keys(spark):
    urls = {"http://www.Example.com:80/a?b#c": "com,example,www)/a?b", "//x": ")//x", "http://u:p@h.org?q": "org,h)?q", None: ")",
            "HTTPS://a.b/ü@x": "b,a)/ü@x"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == urls
