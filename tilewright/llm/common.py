"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.paths import scratch

#: A staged table of at most so many stored bytes may be broadcast.
BROADCAST_BYTES = 4 << 20

#: Rows of texts sent to Python at a time.
BATCH_ROWS = 1000

#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends at most ``BATCH_ROWS`` rows to Python at a time from now on.

    Spark bounds its Arrow batches by rows alone, and the usual 10,000 whole texts are
    tens of megabytes, several times over, in each task. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs the running tasks, not what was written.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a staged table (from the plan's statistics)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if its measured size allows one.

    Beyond the limit the join stays a shuffled one, whose hot keys AQE splits.
    """
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        rows, size, begin = batch.column(column), 0, 0
        for k, x in enumerate(pc.binary_length(rows).to_pylist()):
            size += x or 0
            if size >= limit:
                yield batch.slice(begin, k + 1 - begin)
                begin, size = k + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def as_bytes(name: str, alias: str | None = None):
    """A string column as its UTF-8 bytes, null kept."""
    return F.col(name).cast("binary").alias(alias or name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_caches: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """Declares what an operator keeps in this Python worker, and lets go of what others keep.

    Workers outlive their tasks and serve one operator after another.
    """
    _caches.setdefault(name, clear)
    for other, clear_other in _caches.items():
        if other != name:
            clear_other()
