"""Numpy arrays as raw files in the cluster's shared folder, memory-mapped by the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

from marquee.runtime import checkpoint_root


def new_folder(spark: SparkSession, name: str) -> str:
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/marquee/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _local(folder: str) -> str | None:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if folder.startswith("/") else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write under a name of its own first, so that a repeated task attempt never shows half a file."""
    own = _local(folder)
    if own is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        made = f"{at}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as out:
            out.write(values.tobytes())
        store.move(made, f"{at}/{name}")
        return
    os.makedirs(own, exist_ok=True)
    made = f"{own}/.{name}.{uuid.uuid4().hex}"
    values.tofile(made)
    os.replace(made, f"{own}/{name}")


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped; from a store that is no file system it is fetched to an unlinked file first."""
    own = _local(folder)
    if own is not None:
        path = f"{own}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"{folder}/{name}")
    with tempfile.TemporaryFile() as held, store.open_input_stream(at) as source:
        while block := source.read(1 << 22):
            held.write(block)
        held.flush()
        return np.memmap(held, dtype, "r") if held.tell() else np.zeros(0, dtype)
