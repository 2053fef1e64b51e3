"""Folders that all executors share, and files in them, by Hadoop's and Arrow's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from marquee.runtime import checkpoint_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's full URI below the checkpoint folder.

    A path without a scheme means Hadoop's default file system, as it does for Spark itself.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    if full.startswith("file:"):
        full = "file:///" + full[5:].lstrip("/")
    return f"{full.rstrip('/')}/marquee/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def store_of(uri: str):
    """(Arrow file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
