"""Arrow batches inside tasks: sorted streams cut into whole groups, and small Spark helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A null-free numeric column as numpy."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups of a stream sorted by integer ``keys``.

    A table holds one or more complete groups: all groups that end in a batch come together,
    and only the last, still open group is carried on.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for i, c in enumerate(cols):
            change[1:] |= c[1:] != c[:-1]
            change[0] |= last is not None and c[0] != last[i]
        cuts = np.flatnonzero(change)
        if len(cuts):
            done = [*rest, batch.slice(0, int(cuts[-1]))]
            if any(b.num_rows for b in done):
                yield pa.Table.from_batches(done)
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
        last = [c[-1] for c in cols]
    if rest:
        yield pa.Table.from_batches(rest)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def list_values(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    lengths = pc.list_value_length(col).to_numpy().astype(np.int64)
    return pc.list_flatten(col).to_numpy(), np.append(0, np.cumsum(lengths))


def dealt(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of a key together in one partition, sorted by the keys and then by ``order``."""
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or []))


def text_of(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))
