"""Tables of (target, source) rows against a table of vectors, block against block.

Rows are cut once by ranges of targets, one task each, and stored as slices: a slice is a
task's rows into one block of sources. The vectors are stored once as panels, one per block.
A task takes its slices through the stored panels, so no exchange carries a vector per row;
what leaves the task is one sum per target or one number per row. Where a row needs its
target's vector too, those of a task's targets stand before its slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from marquee.functions import vectors as V
from marquee.runtime import checkpointed, task_slots

SOURCES = 4096         # sources of a block: a panel is this many vectors
RANGE = 4096           # targets of a range: ranges are counted and dealt to tasks
TARGETS = 131_072      # targets of a task at most: it holds one vector for each
SLICE_EDGES = 131_072  # rows of a slice at most
TASK_ROWS = 500_000    # rows of a task: as many tasks as keep the cluster busy, but in these limits
MOST_TASK_ROWS = 8_000_000
STEP = 16_384          # rows multiplied at a time inside a task


@dataclass
class Sliced:
    """Slices (low, block, rows), each sorted by target; a task's slices are one partition.

    ``low`` is the first target that the task may have.
    """

    slices: DataFrame
    sources: int
    tasks: int


def sliced(edges: DataFrame, sources: int = SOURCES, slice_edges: int = SLICE_EDGES) -> Sliced:
    """Stores ``edges`` (src, dst, w) as slices. Edges are taken as they are: parallel ones add up."""
    return cut(edges.select("dst", "src", F.col("w").cast("double").alias("w")), "dst", "src", sources, slice_edges)


def cut(rows: DataFrame, target: str, source: str, sources: int = SOURCES, slice_rows: int = SLICE_EDGES,
        most_rows: int = MOST_TASK_ROWS, whole: bool = False, beside: DataFrame | None = None) -> Sliced:
    """Stores ``rows`` as slices; rows without a target or a source are left out.

    A task takes neighbouring ranges of targets. A range with many rows is cut by source blocks
    into several tasks, unless ``whole`` asks for all rows of a target in one task. The vectors
    of ``beside`` (node, vec), of one length and without nulls, go to the tasks of their targets
    and are stored before the slices, as slices of block -1.
    """
    at, block = (F.floor(F.col(c) / n).cast("int") for c, n in ((target, RANGE), (source, sources)))
    keyed = rows.where(F.col(target).isNotNull() & F.col(source).isNotNull())
    sizes = sorted(tuple(r) for r in keyed.groupBy(at.alias("at")).count().collect())  # one row per 4,096 targets
    aim = min(max(TASK_ROWS, sum(n for _, n in sizes) // (2 * task_slots(rows.sparkSession))), most_rows)
    numbers, tasks, held = [], 0, 0
    for number, n in sizes:
        if not held or held + n > aim or (number + 1) * RANGE - numbers[-1][3] > TARGETS:
            low, held, parts = number * RANGE, 0, 1 if whole else -(-n // aim)
            first, tasks = tasks, tasks + parts
        numbers.append((number, first, parts, low))
        held += n
    ranges = rows.sparkSession.createDataFrame(numbers, "at int, first int, parts int, low int")
    placed = keyed.withColumn("_at", at).join(F.broadcast(ranges), F.col("_at") == F.col("at")).select(
        (F.col("first") + F.pmod(block, F.col("parts"))).cast("int").alias("task"), "low", block.alias("block"),
        F.struct(*rows.columns).alias("row"))
    if beside is not None:
        return Sliced(checkpointed(_cut_beside(placed, beside, ranges, rows, target, source, tasks, slice_rows)), sources, max(1, tasks))
    ordered = placed.repartitionById(max(1, tasks), "task").sortWithinPartitions("block", f"row.{target}", f"row.{source}")
    stored = ordered.select("low", "block", "row").mapInArrow(_packed(slice_rows), StructType([
        StructField("low", IntegerType()), StructField("block", IntegerType()), StructField("rows", ArrayType(rows.schema))]))
    return Sliced(checkpointed(stored), sources, max(1, tasks))


def _cut_beside(placed: DataFrame, beside: DataFrame, ranges: DataFrame, rows: DataFrame, target: str, source: str,
                tasks: int, slice_rows: int) -> DataFrame:
    """Slices (task, low, block, rows, part, own, own_cells); those of block -1 hold vectors instead of rows."""
    vectors = beside.where("node is not null and vec is not null")
    task = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("task")
    row = F.struct(*[(F.col("node") if f.name == target else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    sides = vectors.join(F.broadcast(ranges), F.floor(F.col("node") / RANGE) == F.col("at")).select(
        task, "low", F.lit(-1).alias("block"), row.alias("row"), "vec")
    # empty arrays and not nulls: a batch of null lists is measured anew for each of its rows on the way to Arrow
    both = placed.withColumn("vec", F.array().cast("array<double>")).unionByName(sides)
    ordered = both.repartitionById(max(1, tasks), "task").sortWithinPartitions("block", f"row.{target}", f"row.{source}")
    return ordered.mapInArrow(_packed_beside(slice_rows, rows.columns.index(target)), StructType([
        StructField("task", IntegerType()), StructField("low", IntegerType()), StructField("block", IntegerType()),
        StructField("rows", ArrayType(rows.schema)), StructField("part", IntegerType()),
        StructField("own", BinaryType()), StructField("own_cells", BinaryType())]))


def _packed_beside(limit: int, target: int):
    """One row per run of equal blocks, or per ``limit`` rows of it, from rows (task, low, block, row, vec)."""
    names = ["task", "low", "block", "rows", "part", "own", "own_cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vectors, n, part, now = [], [], 0, 0, None

        def slice_of() -> pa.RecordBatch:
            rows, own, cells = pa.concat_arrays(held), None, None
            if now[2] < 0:
                own = rows.field(target).to_numpy().astype(np.int32).tobytes()
                cells = np.concatenate(vectors).tobytes()
                rows = rows.slice(0, 0)
            return pa.RecordBatch.from_arrays([
                *[pa.array([x], pa.int32()) for x in now],
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([part], pa.int32()), pa.array([own], pa.binary()), pa.array([cells], pa.binary())], names)

        for batch in batches:
            *keys, rows, vecs = (batch.column(c) for c in range(5))
            for lo, hi in _runs(np.column_stack([k.to_numpy() for k in keys])):
                key = tuple(k[lo].as_py() for k in keys)
                most = SOURCES if key[2] < 0 else limit
                while lo < hi:
                    if held and (key != now or n >= most):
                        yield slice_of()
                        held, vectors, n, part = [], [], 0, part + 1
                    now, take = key, min(hi - lo, most - n)
                    held.append(rows.slice(lo, take))
                    if key[2] < 0:
                        vectors.append(vecs.slice(lo, take).flatten().to_numpy())
                    n, lo = n + take, lo + take
        if held:
            yield slice_of()
    return run


def _packed(limit: int):
    """One row per run of equal blocks, or per ``limit`` rows of it, from rows (low, block, row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None

        def slice_of() -> pa.RecordBatch:
            rows = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays([
                pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["low", "block", "rows"])

        for batch in batches:
            low, block, rows = (batch.column(c) for c in range(3))
            for lo, hi in _runs(np.column_stack([low.to_numpy(), block.to_numpy()])):
                key = low[lo].as_py(), block[lo].as_py()
                while lo < hi:
                    if held and (key != now or n >= limit):
                        yield slice_of()
                        held, n = [], 0
                    now, take = key, min(hi - lo, limit - n)
                    held.append(rows.slice(lo, take))
                    n, lo = n + take, lo + take
        if held:
            yield slice_of()
    return run


def _runs(keys: np.ndarray) -> zip:
    """(start, end) of the runs of equal rows."""
    starts = np.flatnonzero(np.append(True, np.any(keys[1:] != keys[:-1], axis=1))) if len(keys) else np.zeros(0, int)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])


def panels(vectors: DataFrame, sources: int = SOURCES, beside: bool = False) -> DataFrame:
    """Stores (node, vec) as one row (at, nodes, cells) per block; null nodes and vectors are left out.

    With ``beside`` each partition begins with a row of block -1: a task that goes through the
    partition first meets the vectors of its own targets there.
    """
    rows = vectors.where("node is not null and vec is not null").select(
        F.floor(F.col("node") / sources).cast("int").alias("at"), F.col("node").cast("int").alias("node"), "vec")
    return checkpointed(rows.repartition("at").sortWithinPartitions("at").mapInArrow(
        _panels_beside if beside else _panels, "at int, nodes binary, cells binary"))


def _panels_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, panel in enumerate(_panels(batches)):
        if not i:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([b""], pa.binary())] * 2], panel.schema.names)
        yield panel


def _panels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, cells, now = [], [], None

    def panel() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([now], pa.int32()), pa.array([np.concatenate(nodes).astype(np.int32).tobytes()], pa.binary()),
            pa.array([np.concatenate(cells).astype(np.float64).tobytes()], pa.binary())], ["at", "nodes", "cells"])

    for batch in batches:
        at, node, vec = (batch.column(c) for c in range(3))
        for lo, hi in _runs(at.to_numpy().reshape(-1, 1)):
            if nodes and at[lo].as_py() != now:
                yield panel()
                nodes, cells = [], []
            now = at[lo].as_py()
            nodes.append(node.slice(lo, hi - lo).to_numpy())
            cells.append(vec.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
    if nodes:
        yield panel()


def walked(matrix: Sliced, stored: DataFrame, run: Callable, schema) -> DataFrame:
    """``run`` over all (low, block, rows, at, nodes, cells) whose panel is of the slice's block.

    The condition is no equality, so nothing is shuffled: each task reads the stored panels
    partition by partition.
    """
    meets = (F.col("block") <= F.col("at")) & (F.col("block") >= F.col("at"))
    return matrix.slices.join(stored, meets).coalesce(matrix.tasks).mapInArrow(run, schema)


def partial_products(matrix: Sliced, emb: DataFrame, dim: int) -> DataFrame:
    """(node, vec) partial sums of weighted source vectors, one per task and target.

    Sources without a vector count as zero.
    """
    return walked(matrix, panels(emb, matrix.sources), _multiply(dim, matrix.sources), "node int, vec array<double>")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(low, block, row columns, nodes, cells) of each slice with its panel."""
    for batch in batches:
        low, block, rows, nodes, cells = (batch.column(batch.schema.get_field_index(c)) for c in ("low", "block", "rows", "nodes", "cells"))
        for i in range(batch.num_rows):
            yield (low[i].as_py(), block[i].as_py(), rows[i].values.flatten(),
                   np.frombuffer(nodes[i].as_buffer(), np.int32), np.frombuffer(cells[i].as_buffer()))


def pair_scores(rows: DataFrame, target: str, source: str, targets: DataFrame, sources: DataFrame, dim: int, out: str) -> DataFrame:
    """``rows`` with the score of their two vectors; rows without a vector on a side are left out.

    ``targets`` and ``sources`` are (node, vec) with vectors of ``dim`` cells, a bias, and the
    vector's true length. The score is null where the lengths differ or one is negative. A
    node given several times meets its rows with each of its vectors.
    """
    matrix = cut(rows, target, source, beside=targets)
    run = _scored(rows.columns, target, source, dim, out)
    return walked(matrix, panels(sources, matrix.sources, beside=True), run, StructType([*rows.schema, StructField(out, DoubleType())]))


def _scored(columns: list[str], target: str, source: str, dim: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}  # by task and part: nodes and vectors
        whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                task, part = column["task"][i].as_py(), column["part"][i].as_py()
                if column["block"][i].as_py() < 0:
                    if part not in own.setdefault(task, {}):
                        own[task][part] = _vectors(column["own"][i], column["own_cells"][i], dim)
                        whole.pop(task, None)
                    continue
                if task not in own:
                    continue
                if task not in whole:
                    parts = [own[task][k] for k in sorted(own[task])]
                    whole[task] = tuple(np.concatenate(x) for x in zip(*parts))
                ids, vecs = whole[task]
                nodes, cells = _vectors(column["nodes"][i], column["cells"][i], dim)
                by_node = np.argsort(nodes, kind="stable")
                row = column["rows"][i].values
                left, right = (row.field(columns.index(c)).to_numpy(zero_copy_only=False) for c in (target, source))
                for lo in range(0, len(row), STEP):
                    mine, at = expanded(ids, left[lo:lo + STEP])
                    other, again = expanded(nodes[by_node], right[lo:lo + STEP][at])
                    p, q, at = vecs[mine[again]], cells[by_node[other]], at[again]
                    score = p[:, dim] + q[:, dim] + np.einsum("ij,ij->i", p[:, :dim], q[:, :dim])
                    void = (p[:, -1] < 0) | (p[:, -1] != q[:, -1])
                    found = row.slice(lo, STEP).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*found.flatten(), pa.array(score, mask=void)], [*columns, out])
    return run


def _vectors(nodes: pa.Scalar, cells: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(nodes.as_buffer(), np.int32), np.frombuffer(cells.as_buffer()).reshape(-1, dim + 2)


def _multiply(dim: int, sources: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by lowest target: the targets' sums, and which have one
        for low, block, row, nodes, cells in met(batches):
            if low not in sums:
                sums[low] = np.zeros((TARGETS, dim)), np.zeros(TARGETS, bool)
            out, has = sums[low]
            panel = np.zeros((sources, dim))
            panel[nodes - block * sources] = cells.reshape(-1, dim)
            dst, src, w = (c.to_numpy(zero_copy_only=False) for c in row)
            dst, src = dst - low, src - block * sources
            has[dst] = True
            for lo in range(0, len(dst), STEP):
                own = dst[lo:lo + STEP]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[starts]] += np.add.reduceat(panel[src[lo:lo + STEP]] * w[lo:lo + STEP, None], starts, axis=0)
        for low, (out, has) in sums.items():
            found = np.flatnonzero(has)
            for lo in range(0, len(found), STEP):
                part = found[lo:lo + STEP]
                yield pa.RecordBatch.from_arrays([pa.array((part + low).astype(np.int32)), vector_lists(out[part])], ["node", "vec"])
    return run


def vector_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    offsets = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets[:len(matrix) + 1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def list_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def product(matrix: Sliced, emb: DataFrame, dim: int, plus: DataFrame | None = None) -> DataFrame:
    """(node, vec): the matrix times ``emb``, plus the vectors of ``plus`` in the same aggregation."""
    parts = partial_products(matrix, emb, dim)
    both = parts if plus is None else parts.unionByName(plus.select(F.col("node").cast("int").alias("node"), "vec"))
    return both.groupBy("node").agg(V.vector_sum(F.col("vec"), dim).alias("vec"))


def expanded(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position in ``ordered``, position in ``wanted``) of equal numbers; ``ordered`` is sorted."""
    lo, hi = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, side="right")
    count = hi - lo
    at = np.repeat(np.arange(len(wanted)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[at], at
