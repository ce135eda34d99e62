"""Shared helpers of the training-data operators.

Everything that is written between two jobs goes below ``spark.checkpoint.dir``
(a folder that driver and executors share).  Python tasks reach it through
``pyarrow.fs`` so that any Hadoop-style address works.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


_LOCAL: list[str] = []  # the folder of a session without a cluster
_MADE: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder.

    Without ``spark.checkpoint.dir`` a temporary folder is used, which goes when Python ends; that works
    only where driver and tasks are one machine, so on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quillspark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    _MADE.append(f"{base.rstrip('/')}/quillspark/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders that this process made, when their results have been used; how many there were."""
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor repeats one job and not the whole chain.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(address: str):
    """(filesystem, path) of an address, for tasks."""
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return fs.FileSystem.from_uri(address)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_text(value) -> str:
    """A text of a batch; null and NaN are empty."""
    return value if isinstance(value, str) else ""
