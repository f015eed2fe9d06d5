"""Transfer traces as streams: an extension, nothing of the kind is in the batch inventory.

Link statistics over event-time windows with a watermark; late rows within it are
counted, later ones dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.traces import transfer_metrics, unchained


def windowed_link_stats(trace: DataFrame, window: str = "1 hour", late: str = "2 hours", routed: bool = False) -> DataFrame:
    """``(begin, dest, src, n, bytes, gbs)`` by window of the event-time column ``ts``.

    ``trace`` is a stream or a table of :mod:`tilewright.operators.traces` rows with ``ts``;
    with ``routed`` each hop of a route counts.
    """
    m = transfer_metrics(trace.withWatermark("ts", late))
    m = unchained(m) if routed else m
    stats = m.where("dest <> src").groupBy(F.window("ts", window), "dest", "src").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.avg("gbs").alias("gbs"))
    return stats.select(F.col("window.start").alias("begin"), "dest", "src", "n", "bytes", "gbs")
