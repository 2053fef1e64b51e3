"""Fill-in-middle by repeated-capture matching.

One full match of (line)* keeps every repetition of its group, so the ends of that group are
all line ends: their number is the number of lines, and both cuts are looked up in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T

LINES = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
SENTINELS = ("<P>", "<S>", "<M>")


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four draws of a document from the digest of seed and id; a null id is the empty text."""
    name = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i:i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, h: list[int], rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix length, middle length, output) of one text."""
    ends = LINES.fullmatch(text).ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    lo, hi = (ends[k - 1] if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    p, s, m = sentinels
    if h[3] % 100 < spm_rate:
        return n, "spm", lo, hi - lo, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", lo, hi - lo, "".join((p, prefix, s, suffix, m, middle))


def _rearranged(seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in T.chunks(batch.column(1)):
                own = ids.slice(chunk.first, len(chunk.bounds) - 1)
                rows = [rearrange(chunk.data[lo:hi].tobytes().decode("utf-8", "replace"), draws(i, seed), rate, spm_rate, sentinels)
                        for i, lo, hi in zip(own.to_pylist(), chunk.bounds[:-1], chunk.bounds[1:])]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row: texts cut at two line ends and rearranged.

    ``rate`` percent of the documents are rearranged, ``spm_rate`` percent of those with the
    suffix first; which ones, and where they are cut, depends on ``seed`` and the id alone.
    A text that is null or empty, or holds a sentinel, stays as it is: form ``plain``, null
    lengths, a null text as the empty one. Rows that repeat an id are cut by the same draws;
    a null id draws as the empty text. Rows are independent of one another, so an empty table
    gives no rows; other columns are not read. Bytes that are no UTF-8 come out as U+FFFD.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rearranged(seed, rate, spm_rate, sentinels),
                           "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text as it was, from an output and its form."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, third, second))
            .when(form == "spm", F.concat(second, third, first)).otherwise(output))
