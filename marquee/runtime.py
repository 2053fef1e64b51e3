"""Session helpers: where intermediate state is kept and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())  # stage tables of the open blocks, outermost first


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="marquee-ckpt-")
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; the result has no lineage and survives executor loss."""
    checkpoint_root(df.sparkSession)
    with _without_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet stage table in the shared folder and read it back.

    With ``by`` the table is partitioned by that column, so a filter on it reads only its files.

    Preferred over :func:`checkpointed` for tables that several plans read, because the
    scan keeps column pruning and filter pushdown, and for small key sets, because a file
    scan has a known size and a checkpoint does not.
    """
    spark = df.sparkSession
    path = "/".join([
        checkpoint_root(spark).rstrip("/"), "marquee",
        spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}",
    ])
    with _without_shuffles(spark):
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    if _open.get():
        _open.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, and not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the stage tables that are written inside when the block ends.

    What has to outlast it is staged by the function that the block is given; no other table
    made inside may be read later.
    """
    own: list[str] = []
    outer = _open.get()
    opened = _open.set((*outer, own))

    def kept(df: DataFrame, name: str) -> DataFrame:
        inside = _open.set(outer)
        try:
            return staged(df, name)
        finally:
            _open.reset(inside)

    try:
        yield kept
    finally:
        _open.reset(opened)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


def task_slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
