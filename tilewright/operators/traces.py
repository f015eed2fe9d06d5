"""Transfer traces: metrics, un-nesting of routes, link matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_nodes(route: Column) -> Column:
    """``[ a b c ]`` as an array of unit ids."""
    return F.split(F.trim(F.regexp_replace(route, r"[\[\]]", "")), r"\s+").cast("array<int>")


def transfer_metrics(trace: DataFrame) -> DataFrame:
    """Adds seconds in the pipe, seconds of transfer and GB/s, which is null for a transfer that took no time."""
    seconds = F.col("complete_t") - F.col("sced_t")
    return trace.select("*", (F.col("complete_t") - F.col("fire_t")).alias("pipe_t"), seconds.alias("transfer_t"), (F.try_divide(F.col("bytes"), seconds) / F.lit(1e9)).alias("gbs"))


def unchained(trace: DataFrame) -> DataFrame:
    """A row for each hop of each route, ``src`` and ``dest`` those of the hop; bytes and times are kept."""
    nodes = route_nodes(F.col("route"))
    hops = F.when(F.size(nodes) > 1, F.arrays_zip(F.slice(nodes, 1, F.size(nodes) - 1).alias("s"), F.slice(nodes, 2, F.size(nodes) - 1).alias("d")))
    kept = [c for c in trace.columns if c not in ("src", "dest")]
    return trace.select(*kept, F.posexplode(hops).alias("hop", "_h")).select(*kept, "hop", F.col("_h.s").alias("src"), F.col("_h.d").alias("dest"))


def all_hops(direct: DataFrame, routed: DataFrame) -> DataFrame:
    """Direct transfers and the hops of routed ones, one bag."""
    return direct.withColumn("hop", F.lit(0)).unionByName(unchained(routed).select(*direct.columns, "hop"))


def link_stats(transfers: DataFrame, cap: float = 50.0) -> DataFrame:
    """Count and mean GB/s by (dest, src), without self-transfers, rates at or over ``cap`` and those without a rate."""
    return transfers.where((F.col("dest") != F.col("src")) & (F.col("gbs") < cap)).groupBy("dest", "src").agg(F.count("*").alias("n"), F.avg("gbs").alias("gbs"))


def link_matrix(stats: DataFrame, units: list[int], value: str) -> DataFrame:
    """A row for each ``dest``, a column ``from_<src>`` for each unit (host: ``from_h``); 0 where no transfer is."""
    name = lambda u: f"from_{'h' if u < 0 else u}"
    return stats.groupBy("dest").agg(*(F.coalesce(F.max(F.when(F.col("src") == u, F.col(value))), F.lit(0)).alias(name(u)) for u in units))


def transfer_class(src: Column, dest: Column) -> Column:
    return F.when(src == dest, "reuse").when(src == -1, "H2D").when(dest == -1, "D2H").otherwise("D2D")
