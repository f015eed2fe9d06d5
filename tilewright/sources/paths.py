"""Folders that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A staged table of at most so many stored bytes may be broadcast.
BROADCAST_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, on a local master only, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_dir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


_open: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """What :func:`scratch` names meanwhile is deleted at the end, but for what is taken out of the list that this gives.

    Results that read such a path must be written before.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        discard(spark, made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders by Spark's own file systems; one that isn't there is none too many."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below :func:`scratch` and read back: what uses it twice computes it once, and losses cost no lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table with a broadcast hint if its stored bytes allow one; beyond, the join is a shuffled one."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tilewright-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"
