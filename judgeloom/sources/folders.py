"""Folders that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir``.  Where that is
    unset, one is made on this machine, which only serves a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Folders made since each of the scratch blocks that are open began.
_made: list[list[str]] = []


def new_folder(spark: SparkSession, prefix: str) -> str:
    path = f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made within go at the end; what is read from them must have been
    written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        remove(spark, *_made.pop())


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
