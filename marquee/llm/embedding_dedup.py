"""Near-duplicate vectors by lattice hashing.

Vectors are projected to blocks of eight random directions and decoded to E8 lattice points;
the points of a table's blocks make one cell. Every vector lives in one cell per table and
also visits neighbouring cells. Cosines are computed inside cells only. A pair is counted in
the first cell it meets in, which both vectors' cells tell, so pairs are never written out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.components import connected_components
from marquee.llm.lattice import cells
from marquee.llm.streams import column, dealt, group_bounds, keyed_groups, list_values
from marquee.llm.text import mix
from marquee.runtime import staged


class Index(NamedTuple):
    tables: int = 8
    blocks: int = 2
    scale: float = 0.9
    probes: int = 1
    members: int = 1024   # of a cell's vectors, one task holds two such blocks


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(unit: np.ndarray, index: Index) -> np.ndarray:
    """(n, tables, 1 + visits) cells."""
    return np.stack([cells(unit, t, index.blocks, index.scale, index.probes) for t in range(index.tables)], axis=1)


def _entries(index: Index):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(lo, 2000)])
                ids, label = part.column("cid").to_numpy(), part.column("label").to_numpy()
                weight = part.column("weight").to_numpy()
                flat, offsets = list_values(part.column("vector"))
                size = np.diff(offsets)
                for dim in np.unique(size):
                    rows = np.flatnonzero(size == dim)
                    x = flat[offsets[rows][:, None] + np.arange(dim)]
                    codes = _codes(_unit(x.astype(np.float64)), index)
                    salt = mix(label[rows].astype(np.uint64) * np.uint64(1 << 16) + np.uint64(dim))
                    n, visits = len(rows), codes.shape[2]
                    key = mix(codes.reshape(n, -1) ^ salt[:, None]).ravel().view(np.int64)
                    home = np.tile(np.arange(visits) == 0, n * index.tables)
                    table = np.tile(np.repeat(np.arange(index.tables), visits), n)
                    at = np.repeat(np.arange(n), index.tables * visits)
                    raw = np.ascontiguousarray(x).view(np.uint8).reshape(n, -1)
                    blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key), pa.array(ids[rows][at]), pa.array(weight[rows][at]), pa.array(table.astype(np.int32)),
                        pa.array(home), blobs.take(pa.array(at))], ["key", "cid", "weight", "table", "home", "vector"])
    return run


def _first_meeting(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, key_is_home_of_i: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) meet in no earlier table, and in this one at this cell first.

    Codes are those of the pair's vectors, i the one with the smaller id. In a table a pair
    can meet in the home of either; the home of i comes first.
    """
    home_i, home_j = codes[i, :, 0], codes[j, :, 0]
    at_i = (codes[j] == home_i[:, :, None]).any(axis=2)
    at_j = (codes[i] == home_j[:, :, None]).any(axis=2)
    earlier = (at_i | at_j)[:, :table].any(axis=1)
    return ~earlier & (key_is_home_of_i | ~at_i[:, table])


def _met(threshold: float, index: Index, dtype: str):
    keys = ["key", "b1", "b2"]

    def run(batches):
        for table in keyed_groups(batches, keys):
            bounds = group_bounds(table, keys)
            cid, weight, which = (table.column(c).to_numpy() for c in ("cid", "weight", "table"))
            home, block = table.column("home").to_numpy(), table.column("block").to_numpy()
            b1, b2 = table.column("b1").to_numpy(), table.column("b2").to_numpy()
            vectors = table.column("vector")
            links, edges = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                x = _unit(np.frombuffer(b"".join(vectors.slice(lo, hi - lo).to_pylist()), dtype).reshape(hi - lo, -1).astype(np.float64))
                near = np.triu(x @ x.T >= threshold, 1) & (home[lo:hi, None] | home[None, lo:hi])
                if b1[lo] != b2[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                swap = cid[lo + i] > cid[lo + j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                own = np.unique(np.concatenate([i, j]))
                codes = _codes(x[own], index)
                first = _first_meeting(codes, np.searchsorted(own, i), np.searchsorted(own, j), int(which[lo]), home[lo + i])
                lowest = np.arange(hi - lo)  # smallest position reachable inside the cell
                while True:
                    before = lowest.copy()
                    np.minimum.at(lowest, i, before[j])
                    np.minimum.at(lowest, j, before[i])
                    lowest = lowest[lowest]
                    if (lowest == before).all():
                        break
                tied = np.flatnonzero(lowest != np.arange(hi - lo))
                edges.append(np.stack([cid[lo + tied], cid[lo + lowest[tied]]], axis=1))
                n = np.zeros(hi - lo, np.int64)
                np.add.at(n, i[first], weight[lo + j[first]])
                np.add.at(n, j[first], weight[lo + i[first]])
                some = np.flatnonzero(n)
                links.append(np.stack([cid[lo + some], n[some]], axis=1))
            for kind, rows in ((True, edges), (False, links)):
                if rows:
                    rows = np.concatenate(rows)
                    rows = np.unique(rows, axis=0) if kind else rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), kind)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["edge", "a", "b"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, index: Index = Index(),
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Vectors of one label and one length link from cosine ``threshold`` on, computed in double
    precision; vectors that are null, empty, zero or hold null or non-finite components, and
    those without a label, link with nothing. Equal vectors are compared once and counted as
    often as they occur. ``component_id`` is the smallest id reachable by links, ``kept``
    says that it is the row's own. Rows that repeat an id are vectors of their own. Every
    vector is indexed; what the tables miss is the only loss.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"),
                          F.col(label_col).cast("bigint").alias("label"))
    finite = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    usable = F.expr(f"coalesce(label is not null and size(vector) > 0 and {finite} and exists(vector, x -> x <> 0), false)")
    rows = staged(rows.withColumn("usable", usable), "vectors")
    element = rows.schema["vector"].dataType.elementType
    if element.typeName() not in ("float", "double"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    dtype = "<f4" if element.typeName() == "float" else "<f8"
    good = rows.where("usable")
    classes = staged(good.groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    entries = classes.select("cid", "label", "weight", "vector").mapInArrow(
        _entries(index), "key long, cid long, weight long, table int, home boolean, vector binary")
    crowded = (classes.select("cid", "label", "weight", "vector").mapInArrow(
        _entries(index), "key long, cid long, weight long, table int, home boolean, vector binary")
        .groupBy("key").count().where(F.col("count") > index.members)
        .select("key", F.ceil(F.col("count") / index.members).cast("int").alias("blocks")))
    spread = (entries.join(staged(crowded, "crowded"), "key", "left")
              .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                      "block", "cid", "weight", "table", "home", "vector"))
    met = staged(dealt(spread, ["key", "b1", "b2"], ["cid"]).mapInArrow(
        _met(threshold, index, dtype), "edge boolean, a long, b long"), "vector-links")
    counts = met.where("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    groups = connected_components(met.where("edge").select("a", "b")).withColumnRenamed("node", "cid")
    named = (classes.select("cid", "label", "vector", "low", "weight").join(counts, "cid", "left").join(groups, "cid", "left")
             .withColumn("component", F.coalesce("component", "cid")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select(
        "label", "vector", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
