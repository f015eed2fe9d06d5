"""Trace analytics. The trace is derived from every row of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import traces as tr
from tilewright.queries.registry import query, r, table

TRACE_SQL = """trace AS (SELECT event_id, (user_id % 9)::INT - 1 AS src, (event_id % 9)::INT - 1 AS dest,
  CASE WHEN event_id % 3 = 0 THEN '[ ' || ((user_id % 9)::INT - 1) || ' ' || ((event_id // 9) % 8) || ' ' || ((event_id % 9)::INT - 1) || ' ]'
       ELSE '[ ' || ((user_id % 9)::INT - 1) || ' ' || ((event_id % 9)::INT - 1) || ' ]' END AS route, event_id % 3 = 0 AS routed,
  33554432::BIGINT AS bytes, event_id / 1024.0::DOUBLE AS fire_t, event_id / 1024.0::DOUBLE + 0.125 AS sced_t, event_id / 1024.0::DOUBLE + 0.125 + value / 65536 AS complete_t FROM events),
m AS (SELECT *, complete_t - fire_t AS pipe_t, complete_t - sced_t AS transfer_t, bytes / nullif(complete_t - sced_t, 0) / 1e9 AS gbs FROM trace)"""
HOPS_SQL = f"""{TRACE_SQL}, n AS (SELECT *, list_transform(string_split(trim(replace(replace(route, '[', ''), ']', '')), ' '), lambda x: x::INT) AS nodes FROM m),
hops AS (SELECT event_id, h - 1 AS hop, nodes[h] AS src, nodes[h + 1] AS dest, gbs, bytes FROM n, range(1, 3) r(h) WHERE routed AND h < len(nodes)),
u AS (SELECT event_id, src, dest, gbs, 0 AS hop FROM m WHERE NOT routed UNION ALL SELECT event_id, src, dest, gbs, hop FROM hops)"""


def trace(spark, sf):
    c = F.col
    src, dest = (c("user_id") % 9).cast("int") - 1, (c("event_id") % 9).cast("int") - 1
    nodes = F.when(c("event_id") % 3 == 0, F.array(src, F.expr("event_id div 9 % 8").cast("int"), dest)).otherwise(F.array(src, dest))
    fire = c("event_id") / F.lit(1024.0)
    return table(spark, sf, "events").select(
        "event_id", src.alias("src"), dest.alias("dest"), F.concat(F.lit("[ "), F.array_join(nodes.cast("array<string>"), " "), F.lit(" ]")).alias("route"), (c("event_id") % 3 == 0).alias("routed"),
        F.lit(33554432).cast("long").alias("bytes"), fire.alias("fire_t"), (fire + 0.125).alias("sced_t"), (fire + 0.125 + c("value") / 65536).alias("complete_t"),
    )


def hops(spark, sf):
    m = tr.transfer_metrics(trace(spark, sf))
    return tr.all_hops(m.where("NOT routed"), m.where("routed"))


@query("prj12_transfer_metrics", f"WITH {TRACE_SQL} SELECT event_id, pipe_t, transfer_t, round(gbs, 6) + 0.0 AS gbs FROM m")
def prj12_transfer_metrics(spark, sf):
    return tr.transfer_metrics(trace(spark, sf)).select("event_id", "pipe_t", "transfer_t", r("gbs").alias("gbs"))


@query("tf1_route_unchain", f"WITH {HOPS_SQL} SELECT event_id, hop::INT AS hop, src, dest, bytes, round(gbs, 6) + 0.0 AS gbs FROM hops")
def tf1_route_unchain(spark, sf):
    found = tr.unchained(tr.transfer_metrics(trace(spark, sf)).where("routed"))
    return found.select("event_id", "hop", "src", "dest", "bytes", r("gbs").alias("gbs"))


@query("set3_all_hops", f"WITH {HOPS_SQL} SELECT hop::INT AS hop, count(*) AS n, count(DISTINCT (src, dest)) AS pairs, round(avg(gbs), 6) + 0.0 AS gbs FROM u GROUP BY 1")
def set3_all_hops(spark, sf):
    """Direct transfers and un-nested hops together."""
    return hops(spark, sf).groupBy("hop").agg(F.count("*").alias("n"), F.countDistinct("src", "dest").alias("pairs"), r(F.avg("gbs")).alias("gbs"))


@query("ag20_link_stats", f"WITH {HOPS_SQL} SELECT dest, src, count(*) AS n, round(avg(gbs), 6) + 0.0 AS gbs FROM u WHERE dest <> src AND gbs < 50 GROUP BY ALL")
def ag20_link_stats(spark, sf):
    return tr.link_stats(hops(spark, sf)).select("dest", "src", "n", r("gbs").alias("gbs"))


COLS = ", ".join(f"coalesce(max(n) FILTER (src = {u}), 0) AS from_{'h' if u < 0 else u}" for u in range(-1, 8))


@query("ag20_link_matrix", f"WITH {HOPS_SQL}, s AS (SELECT dest, src, count(*) AS n FROM u WHERE dest <> src AND gbs < 50 GROUP BY ALL) SELECT dest, {COLS} FROM s GROUP BY dest")
def ag20_link_matrix(spark, sf):
    return tr.link_matrix(tr.link_stats(hops(spark, sf)), list(range(-1, 8)), "n")


@query("ag21_transfer_classes", f"WITH {TRACE_SQL}, d AS (SELECT CASE WHEN src = dest THEN 'reuse' WHEN src = -1 THEN 'H2D' WHEN dest = -1 THEN 'D2H' ELSE 'D2D' END AS class, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS rw FROM m) SELECT coalesce(class, 'all') AS class, coalesce(rw, 'all') AS rw, count(*) AS n FROM d GROUP BY CUBE (class, rw)")
def ag21_transfer_classes(spark, sf):
    """Counts by class and direction, with totals."""
    rw = F.when(F.col("event_id") % 2 == 0, "read").otherwise("write")
    d = trace(spark, sf).select(tr.transfer_class(F.col("src"), F.col("dest")).alias("class"), rw.alias("rw"))
    return d.cube("class", "rw").agg(F.count("*").alias("n")).select(F.coalesce("class", F.lit("all")).alias("class"), F.coalesce("rw", F.lit("all")).alias("rw"), "n")


@query("ag22_unit_rates", f"WITH {TRACE_SQL} SELECT dest, count(*) AS n, round(avg(gbs), 6) + 0.0 AS mean_gbs, round(sum(transfer_t), 6) + 0.0 AS busy, round(max(pipe_t), 9) + 0.0 AS longest FROM m GROUP BY dest")
def ag22_unit_rates(spark, sf):
    """Mean achieved rate, busy time and longest wait of each unit."""
    m = tr.transfer_metrics(trace(spark, sf))
    return m.groupBy("dest").agg(F.count("*").alias("n"), r(F.avg("gbs")).alias("mean_gbs"), r(F.sum("transfer_t")).alias("busy"), r(F.max("pipe_t"), 9).alias("longest"))


@query("ag24_makespan", f"WITH {TRACE_SQL}, g AS (SELECT (event_id // 64) AS run, dest, sum(transfer_t) AS t FROM m GROUP BY ALL) SELECT run, round(max(t), 9) + 0.0 AS makespan, round(sum(t * (100 + 10 * dest)), 6) + 0.0 AS joules, count(*) AS units FROM g GROUP BY run")
def ag24_makespan(spark, sf):
    """The slowest unit's time and all units' energy."""
    g = tr.transfer_metrics(trace(spark, sf)).groupBy(F.expr("event_id div 64").alias("run"), "dest").agg(F.sum("transfer_t").alias("t"))
    return g.groupBy("run").agg(r(F.max("t"), 9).alias("makespan"), r(F.sum(F.col("t") * (100 + 10 * F.col("dest")))).alias("joules"), F.count("*").alias("units"))


@query("ord4_top_links", f"WITH {HOPS_SQL} SELECT dest, src, n FROM (SELECT dest, src, count(*) AS n FROM u WHERE dest <> src GROUP BY ALL) ORDER BY n DESC, dest, src LIMIT 10")
def ord4_top_links(spark, sf):
    """The ten busiest links."""
    s = hops(spark, sf).where("dest <> src").groupBy("dest", "src").agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "dest", "src").limit(10)


@query("ag16_slowdown", f"WITH {TRACE_SQL}, a AS (SELECT dest, src, avg(transfer_t) FILTER (event_id // 9 % 2 = 0) AS alone, avg(transfer_t) FILTER (event_id // 9 % 2 = 1) AS over_ FROM m GROUP BY ALL) SELECT dest, src, round(over_ / nullif(alone, 0), 6) + 0.0 AS sl FROM a WHERE alone IS NOT NULL AND over_ IS NOT NULL")
def ag16_slowdown(spark, sf):
    """Time with company over time alone, by link; every second transfer has company."""
    alone = F.expr("event_id div 9 % 2 = 0")
    a = tr.transfer_metrics(trace(spark, sf)).groupBy("dest", "src").agg(F.avg(F.when(alone, F.col("transfer_t"))).alias("alone"), F.avg(F.when(~alone, F.col("transfer_t"))).alias("over"))
    return a.where("alone IS NOT NULL AND over IS NOT NULL").select("dest", "src", r(F.try_divide(F.col("over"), F.col("alone"))).alias("sl"))


@query("flt12_bandwidth_cap", f"WITH {TRACE_SQL} SELECT count(*) AS n, count(*) FILTER (gbs < 50) AS kept, count(*) FILTER (src <> dest) AS moving FROM m")
def flt12_bandwidth_cap(spark, sf):
    return tr.transfer_metrics(trace(spark, sf)).agg(F.count("*").alias("n"), F.count_if(F.col("gbs") < 50).alias("kept"), F.count_if(F.col("src") != F.col("dest")).alias("moving"))
