"""The folder that driver and executors share, and file systems by URI."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of our own where unset; only in local mode, as executors elsewhere would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='marlspike-')}")
    return sc.getCheckpointDir()


def filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in uri:  # a path as it is, with any characters
        return LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))
    return FileSystem.from_uri(uri)
