"""Cost models, link maps, tile choice and distribution.

Every row of ``part`` is a problem: its dimensions, tile and locations follow from its
columns. The lookup table and the links are made by formulas that both engines share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.metrics import near_value_means
from tilewright.operators import ordering as od
from tilewright.plans import links as lk
from tilewright.plans import models as cm
from tilewright.plans import tuner as tn
from tilewright.queries.registry import query, r, table

LOOKUP_SQL = "lookup AS (SELECT (256 * k)::BIGINT AS T, 1e-5::DOUBLE + 2 * (256.0::DOUBLE * k) ** 3 / 7e12 AS t_s, 200.0::DOUBLE + 4 * k AS w FROM range(1, 17) x(k))"
PROB_SQL = """prob AS (SELECT p_partkey AS pid, 512 * (1 + p_size % 7) AS D1, 512 * (1 + p_partkey % 5)::BIGINT AS D2, 512 * (1 + (p_partkey // 5) % 9)::BIGINT AS D3, (100 + 97 * (p_size % 60))::BIGINT AS T_in,
(p_partkey % 4)::INT AS unit, (p_partkey % 3)::INT AS loc_a, (p_size % 4) AS loc_b, (p_partkey // 7 % 4)::INT AS loc_c, p_retailprice / 1000 AS score FROM part)"""
NEAR_SQL = f"{LOOKUP_SQL}, {PROB_SQL}, near AS (SELECT p.*, l.T AS T_near, l.t_s AS sec_near, l.w AS w_near FROM prob p JOIN lookup l ON l.T = coalesce((SELECT max(T) FROM lookup WHERE T <= T_in), (SELECT min(T) FROM lookup)))"
LINK_SQL = """cnt AS (SELECT (event_id % 9)::INT - 1 AS dest, (user_id % 9)::INT - 1 AS src, count(*) AS n FROM events GROUP BY ALL),
ends AS (SELECT d::INT AS dest, s::INT AS src, coalesce(n, 0) AS n FROM range(-1, 4) a(d) CROSS JOIN range(-1, 4) b(s) LEFT JOIN cnt ON cnt.dest = d AND cnt.src = s),
link AS (SELECT dest, src, CASE WHEN dest = src THEN 0.0 ELSE 1e-5 * (1 + (dest * 3 + src + n + 8) % 4) END::DOUBLE AS ti, CASE WHEN dest = src THEN 0.0 ELSE 1e-10 / (1 + (dest * 5 + src * 3 + n + 8) % 7) END::DOUBLE AS tb FROM ends),
edge AS (SELECT dest, src, 5.0::DOUBLE * (1 + (dest * 5 + src * 3 + n + 8) % 7) AS bw, CASE WHEN (dest + src) % 3 = 1 THEN -1.0 ELSE 4.0::DOUBLE * (1 + (dest + src * 2 + n + 3) % 5) END::DOUBLE AS bw_shared, (3 - dest - 1)::INT AS p_dest, src AS p_src FROM ends)"""


def lookup(spark):
    k = F.col("id")
    return spark.range(1, 17).select((256 * k).alias("T"), (F.lit(1e-5) + 2 * F.pow(256.0 * k, F.lit(3.0)) / 7e12).alias("sec"), (200.0 + 4 * k).alias("w"))


def problems(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("pid"), (512 * (1 + size % 7)).cast("long").alias("D1"), (512 * (1 + k % 5)).alias("D2"), (512 * (1 + F.expr("p_partkey div 5") % 9)).alias("D3"), (100 + 97 * (size % 60)).cast("long").alias("T_in"),
        (k % 4).cast("int").alias("unit"), (k % 3).cast("int").alias("loc_a"), (size % 4).alias("loc_b"), (F.expr("p_partkey div 7") % 4).cast("int").alias("loc_c"), (F.col("p_retailprice") / 1000).alias("score"))


def near(spark, sf):
    return cm.nearest(problems(spark, sf), lookup(spark))


def ends(spark, sf):
    """Links between five units, with the number of the trace's transfers over each."""
    units = spark.range(-1, 4)
    grid = units.select(F.col("id").cast("int").alias("dest")).crossJoin(units.select(F.col("id").cast("int").alias("src")))
    e = table(spark, sf, "events").groupBy(((F.col("event_id") % 9).cast("int") - 1).alias("dest"), ((F.col("user_id") % 9).cast("int") - 1).alias("src")).agg(F.count("*").alias("n"))
    return grid.join(e, ["dest", "src"], "left").fillna(0, "n")


def link(spark, sf):
    d, s, n = F.col("dest"), F.col("src"), F.col("n")
    zero = F.when(d == s, F.lit(0.0))
    return ends(spark, sf).select("dest", "src", zero.otherwise(1e-5 * (1 + (d * 3 + s + n + 8) % 4)).alias("ti"), zero.otherwise(F.lit(1e-10) / (1 + (d * 5 + s * 3 + n + 8) % 7)).alias("tb"))


def edge(spark, sf):
    d, s, n = F.col("dest"), F.col("src"), F.col("n")
    return ends(spark, sf).select("dest", "src", (5.0 * (1 + (d * 5 + s * 3 + n + 8) % 7)).alias("bw"), F.when((d + s) % 3 == 1, F.lit(-1.0)).otherwise(4.0 * (1 + (d + s * 2 + n + 3) % 5)).alias("bw_shared"), (2 - d).alias("p_dest"), s.alias("p_src"))


@query("cm1_tile_lookup", f"WITH {NEAR_SQL} SELECT pid, T_near, round(sec_near * (T_in::DOUBLE / T_near) ** 3 * 1e6, 6) + 0.0 AS us, round(sec_near * (T_in::DOUBLE / T_near) ** 2 * 1e6, 6) + 0.0 AS us_level2, round(sec_near * (T_in::DOUBLE / T_near) * 1e6, 6) + 0.0 AS us_level1, w_near FROM near")
def cm1_tile_lookup(spark, sf):
    """As-of lookup and rescale, with the cube and with each level's own power."""
    n = near(spark, sf)
    us = lambda level, compat: r(cm.rescaled(F.col("sec_near"), F.col("T_in"), F.col("T_near"), level, compat) * 1e6)
    return n.select("pid", "T_near", us(3, True).alias("us"), us(2, False).alias("us_level2"), us(1, False).alias("us_level1"), "w_near")


@query("jn7_asof_join", f"WITH {NEAR_SQL} SELECT T_near, count(*) AS n, min(T_in) AS low, max(T_in) AS high FROM near GROUP BY 1")
def jn7_asof_join(spark, sf):
    return near(spark, sf).groupBy("T_near").agg(F.count("*").alias("n"), F.min("T_in").alias("low"), F.max("T_in").alias("high"))


@query("jn7_asof_large", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 AS k, l_extendedprice AS price FROM lineitem),
t AS (SELECT o_orderkey % 3 AS k, o_totalprice AS price, max(o_orderkey) AS o FROM orders GROUP BY ALL), f AS (SELECT k, min(price) AS price, arg_min(o, price) AS o FROM t GROUP BY k)
SELECT l_orderkey, l_linenumber, l_partkey, l.price, coalesce(t.price, f.price) AS price_found, coalesce(t.o, f.o) AS o FROM l ASOF LEFT JOIN t ON l.k = t.k AND l.price >= t.price LEFT JOIN f ON f.k = l.k""")
def jn7_asof_large(spark, sf):
    """Every line item with the dearest order not dearer than it, of three groups: both sides are tables of any size."""
    c = F.col
    left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_linenumber") % 3).cast("long").alias("k"), c("l_extendedprice").alias("price"))
    right = table(spark, sf, "orders").select((c("o_orderkey") % 3).cast("long").alias("k"), c("o_totalprice").alias("price"), c("o_orderkey").alias("o"))
    return od.asof_join(left, right, ["k"], "price", ["o"]).select("l_orderkey", "l_linenumber", "l_partkey", "price", F.col("at_found").alias("price_found"), "o")


@query("cm4_transfer_time", f"WITH {PROB_SQL}, {LINK_SQL} SELECT pid, dest, src, round(CASE WHEN b < 0 THEN -1 WHEN b = 0 THEN 0 ELSE ti + tb * b END * 1e6, 6) + 0.0 AS us FROM (SELECT *, 8 * (D1 - 1024) * D2 AS b FROM prob) p JOIN link ON dest = unit AND src = loc_b - 1")
def cm4_transfer_time(spark, sf):
    """Operand to link by location, then latency and bytes."""
    p = problems(spark, sf).withColumn("b", 8 * (F.col("D1") - 1024) * F.col("D2"))
    j = p.join(F.broadcast(link(spark, sf)), (F.col("dest") == F.col("unit")) & (F.col("src") == F.col("loc_b") - 1))
    return j.select("pid", "dest", "src", r(cm.transfer(F.col("ti"), F.col("tb"), F.col("b")) * 1e6).alias("us"))


@query("cm5_shared_transfer", f"WITH {LINK_SQL} SELECT e.dest, e.src, round(CASE WHEN e.src = e.dest THEN 0 ELSE l.ti + 33554432 / (1e9 * CASE WHEN e.bw_shared = -1 THEN p.bw_shared ELSE e.bw_shared END) END * 1e6, 6) + 0.0 AS us FROM edge e JOIN link l USING (dest, src) LEFT JOIN edge p ON p.dest = e.p_dest AND p.src = e.p_src")
def cm5_shared_transfer(spark, sf):
    """Over shared links; -1 follows the partner link."""
    e = edge(spark, sf)
    p = e.select(F.col("dest").alias("_d"), F.col("src").alias("_s"), F.col("bw_shared").alias("pb"))
    j = e.join(p, (F.col("p_dest") == F.col("_d")) & (F.col("p_src") == F.col("_s")), "left").join(link(spark, sf), ["dest", "src"])
    return j.select("dest", "src", r(cm.shared_transfer(F.col("src"), F.col("dest"), F.col("ti"), F.col("bw_shared"), F.col("pb"), F.lit(33554432)) * 1e6).alias("us"))


@query("cm7_both_ways", f"""WITH {LINK_SQL}, x AS (SELECT a.dest, a.src, a.ti AS tix, a.tb AS tbx, b.ti AS tiy, b.tb AS tby, 1.25::DOUBLE AS sx, 1.5::DOUBLE AS sy, 8388608 AS bx, 33554432 AS b_y FROM link a JOIN link b ON a.dest = b.src AND a.src = b.dest WHERE a.dest <> a.src),
y AS (SELECT *, tix + tbx * bx * sx AS x, tiy + tby * b_y * sy AS y FROM x)
SELECT dest, src, round(CASE WHEN x <= y THEN x * (1 - 1 / sy) + b_y * tby + tiy / sy ELSE y * (1 - 1 / sx) + bx * tbx + tix / sx END * 1e6, 6) + 0.0 AS us, round(x * 1e6, 6) + 0.0 AS slowed_us FROM y""")
def cm7_both_ways(spark, sf):
    e = link(spark, sf)
    back = e.select(F.col("dest").alias("src"), F.col("src").alias("dest"), F.col("ti").alias("ti2"), F.col("tb").alias("tb2"))
    c = F.col
    us = cm.both_ways(c("ti"), c("tb"), F.lit(8388608), F.lit(1.25), c("ti2"), c("tb2"), F.lit(33554432), F.lit(1.5))
    return e.join(back, ["dest", "src"]).where("dest <> src").select("dest", "src", r(us * 1e6).alias("us"), r(cm.slowed_transfer(c("ti"), c("tb"), F.lit(8388608), F.lit(1.25)) * 1e6).alias("slowed_us"))


PRED_SQL = f"""WITH {LOOKUP_SQL}, {PROB_SQL}, tiles AS (SELECT *, least(4096, D1, D2, D3) AS Tb FROM prob), full_ AS (SELECT t.*, D1::DOUBLE / l.T * D2 / l.T * D3 / l.T * l.t_s AS full_t, l.t_s AS tile_t, l.T AS tile FROM tiles t JOIN lookup l ON l.T = t.Tb // 256 * 256),
{LINK_SQL}, ops AS (SELECT pid, 'a' AS op, D1 * D3 * 8 AS b, loc_a - 1 AS loc, 0 AS sent FROM full_ UNION ALL SELECT pid, 'b', D3 * D2 * 8, loc_b - 1, 0 FROM full_ UNION ALL SELECT pid, 'c', D1 * D2 * 8, loc_c - 1, 1 FROM full_),
costs AS (SELECT f.pid, sum(l.ti + l.tb * o.b) FILTER (o.loc <> f.unit) AS recv, sum(k.ti + k.tb * o.b) FILTER (o.sent = 1 AND o.loc <> f.unit) AS send, count(*) FILTER (o.loc <> f.unit) AS far FROM full_ f JOIN ops o USING (pid) JOIN link l ON l.dest = f.unit AND l.src = o.loc JOIN link k ON k.dest = o.loc AND k.src = f.unit GROUP BY f.pid)"""


def predicted(spark, sf):
    """Problems with whole-problem time, and receive and send sums over their remote operands."""
    p = problems(spark, sf).withColumn("Tb", cm.model_tile(F.lit(4096), F.col("D1"), F.col("D2"), F.col("D3")))
    full = cm.nearest(p, lookup(spark), tile="Tb").withColumn("full_t", cm.full_time(F.col("sec_near"), F.col("T_near"), F.col("D1"), F.col("D2"), F.col("D3")))
    op = lambda loc, size, sent: F.struct((F.col(loc) - 1).alias("loc"), size.alias("b"), F.lit(sent).alias("sent"))
    ops = full.select("*", F.explode(F.array(op("loc_a", 8 * F.col("D1") * F.col("D3"), 0), op("loc_b", 8 * F.col("D3") * F.col("D2"), 0), op("loc_c", 8 * F.col("D1") * F.col("D2"), 1))).alias("o"))
    e = link(spark, sf)
    there = e.select(F.col("dest").alias("to1"), F.col("src").alias("from1"), F.col("ti").alias("ti1"), F.col("tb").alias("tb1"))
    back = e.select(F.col("dest").alias("to2"), F.col("src").alias("from2"), F.col("ti").alias("ti2"), F.col("tb").alias("tb2"))
    j = ops.join(F.broadcast(there), (F.col("to1") == F.col("unit")) & (F.col("from1") == F.col("o.loc"))).join(F.broadcast(back), (F.col("to2") == F.col("o.loc")) & (F.col("from2") == F.col("unit")))
    far = F.col("o.loc") != F.col("unit")
    sums = j.groupBy("pid").agg(
        F.first("full_t").alias("full_t"), F.first("sec_near").alias("tile_t"), F.first("T_near").alias("tile"), *(F.first(d).alias(d) for d in ("D1", "D2", "D3")),
        F.sum(F.when(far, cm.transfer(F.col("ti1"), F.col("tb1"), F.col("o.b")))).alias("recv"), F.sum(F.when(far & (F.col("o.sent") == 1), cm.transfer(F.col("ti2"), F.col("tb2"), F.col("o.b")))).alias("send"), F.count_if(far).alias("far"))
    return sums.fillna(0.0, ["recv", "send"])


@query("cm9_overlap_models", PRED_SQL + """ SELECT pid, round(full_t * 1e6, 4) + 0.0 AS full_us, round(greatest(full_t, coalesce(recv, 0), coalesce(send, 0)) * 1e6, 4) + 0.0 AS overlap_us, round((full_t + coalesce(recv, 0) + coalesce(send, 0)) * 1e6, 4) + 0.0 AS no_overlap_us, far FROM full_ JOIN costs USING (pid)""")
def cm9_overlap_models(spark, sf):
    """Full and no overlap of compute, receive and send."""
    p = predicted(spark, sf)
    f, rc, s = F.col("full_t"), F.col("recv"), F.col("send")
    return p.select("pid", r(f * 1e6, 4).alias("full_us"), r(cm.full_overlap(f, rc, s) * 1e6, 4).alias("overlap_us"), r(cm.zero_overlap(f, rc, s) * 1e6, 4).alias("no_overlap_us"), "far")


#: Bytes that peers bring together; not a multiple of their number, so parts are cut down to whole bytes.
PEER_BYTES = 33554433


@query("cm24_peer_bandwidth", f"""WITH {LINK_SQL}, shared AS (SELECT e.dest, e.src, l.ti, CASE WHEN e.bw_shared = -1 THEN coalesce(nullif(p.bw_shared, -1), e.bw) ELSE e.bw_shared END AS bw FROM edge e JOIN link l USING (dest, src) LEFT JOIN edge p ON p.dest = e.p_dest AND p.src = e.p_src),
peers AS (SELECT *, count(*) OVER (PARTITION BY dest) AS n FROM shared WHERE dest <> src)
SELECT dest, round({PEER_BYTES} / (sum(bw) * 0.8::DOUBLE ** any_value(n) * 1e9) * 1e6, 6) + 0.0 AS sum_us, round(sum(ti + ({PEER_BYTES} // n) / (1e9 * bw)) * 1e6, 6) + 0.0 AS mean_us, count(*) AS peers FROM peers GROUP BY dest""")
def cm24_peer_bandwidth(spark, sf):
    """Bytes over all peers' shared links at once, and in equal parts one after the other."""
    shared = lk.resolved(edge(spark, sf)).join(link(spark, sf), ["dest", "src"]).where("dest <> src")
    e = shared.groupBy("dest").agg(F.sort_array(F.collect_list(F.struct("src", "ti", F.col("bw_shared").alias("bw")))).alias("l"))
    sums = cm.sum_bandwidth_time(F.lit(PEER_BYTES), F.transform("l", lambda x: x["bw"]))
    return e.select("dest", r(sums * 1e6).alias("sum_us"), r(cm.mean_bandwidth_time(F.lit(PEER_BYTES), F.col("l")) * 1e6).alias("mean_us"), F.size("l").cast("long").alias("peers"))


@query("cm28_watts_and_limits", f"WITH {LOOKUP_SQL}, {PROB_SQL} SELECT pid, (SELECT arg_max(w, T) FROM lookup) AS watts, greatest((SELECT min(T) FROM lookup), 1024) AS min_t, least(D1, D2, D3) AS max_t, (SELECT max(T) FROM lookup) AS top FROM prob")
def cm28_watts_and_limits(spark, sf):
    """Watts at the largest benchmarked tile; least and greatest allowed tiles."""
    ends = lookup(spark).agg(F.max_by("w", "T").alias("watts"), F.greatest(F.min("T"), F.lit(1024)).alias("min_t"), F.max("T").alias("top"))
    return problems(spark, sf).join(F.broadcast(ends)).select("pid", "watts", "min_t", F.least(F.col("D1"), F.col("D2"), F.col("D3")).alias("max_t"), "top")


@query("lm5_one_hop_routes", f"""WITH {LINK_SQL}, e AS (SELECT * FROM edge WHERE dest <> src), v AS (SELECT a.src, b.dest, a.dest AS u, 0.8::DOUBLE * least(a.bw, b.bw) AS hop FROM e a JOIN e b ON b.src = a.dest AND b.dest <> a.src),
k AS (SELECT v.*, max(hop) OVER (PARTITION BY v.dest, v.src) AS top, e.bw FROM v JOIN e ON e.dest = v.dest AND e.src = v.src WHERE hop > e.bw)
SELECT e.dest, e.src, coalesce(x.top, e.bw) AS bw, coalesce(x.routes, '') AS routes FROM e LEFT JOIN (SELECT dest, src, any_value(top) AS top, string_agg(u::VARCHAR, ',' ORDER BY u) AS routes FROM k WHERE hop = top GROUP BY ALL) x ON x.dest = e.dest AND x.src = e.src""")
def lm5_one_hop_routes(spark, sf):
    return lk.one_hop_routes(edge(spark, sf)).select("dest", "src", "bw", F.array_join(F.col("routes").cast("array<string>"), ",").alias("routes"))


SLOW_SQL = """slow AS (SELECT a.dest, a.src, b.dest AS odest, b.src AS osrc, 0.9::DOUBLE + ((a.dest * 7 + a.src * 3 + b.dest * 2 + b.src + 20) % 13) / 8.0::DOUBLE AS sl FROM link a, link b WHERE a.dest <> a.src AND b.dest <> b.src AND (a.dest <> b.dest OR a.src <> b.src)),
hopped AS (SELECT DISTINCT a.src, b.dest FROM edge a JOIN edge b ON b.src = a.dest AND b.dest <> a.src JOIN edge e ON e.dest = b.dest AND e.src = a.src WHERE a.dest <> a.src AND b.dest <> b.src AND 0.8::DOUBLE * least(a.bw, b.bw) > e.bw),
act AS (SELECT dest, src, p_dest, p_src FROM edge WHERE dest <> src AND ((dest IN (0, 1, 2) AND src IN (-1, 0, 1, 2)) OR (src IN (0, 1, 2) AND dest IN (-1, 0)))),
live AS (SELECT * FROM act ANTI JOIN hopped USING (dest, src)),
bringing AS (SELECT dest, src FROM edge e WHERE dest <> src AND dest IN (0, 1, 2) AND src IN (-1, 0) AND NOT EXISTS (SELECT 1 FROM hopped h WHERE h.dest = e.dest AND h.src = e.src)),
hit AS (SELECT l.dest, l.src, max(s.sl) AS sl FROM live l JOIN slow s ON s.dest = l.dest AND s.src = l.src JOIN bringing o ON o.dest = s.odest AND o.src = s.osrc WHERE NOT (s.odest = l.p_dest AND s.osrc = l.p_src) GROUP BY ALL),
causes AS (SELECT DISTINCT s.odest AS dest, s.osrc AS src FROM slow s JOIN act v ON v.dest = s.dest AND v.src = s.src WHERE s.sl > 1.05)"""


def slowdowns(spark, sf):
    a = link(spark, sf).where("dest <> src").select("dest", "src")
    b = a.select(F.col("dest").alias("odest"), F.col("src").alias("osrc"))
    c = F.col
    return a.join(b, (c("dest") != c("odest")) | (c("src") != c("osrc"))).withColumn("sl", 0.9 + (c("dest") * 7 + c("src") * 3 + c("odest") * 2 + c("osrc") + 20) % 13 / 8.0)


@query("lm6_residual_slowdown", f"WITH {LINK_SQL}, {SLOW_SQL} SELECT l.dest, l.src, least(2.0, greatest(1.0, coalesce(hit.sl, 1.0)))::DOUBLE AS sl, c.dest IS NOT NULL AS causes FROM live l LEFT JOIN hit ON hit.dest = l.dest AND hit.src = l.src LEFT JOIN causes c ON c.dest = l.dest AND c.src = l.src")
def lm6_residual_slowdown(spark, sf):
    """What links that bring operands cost each active one after rerouting, and whether it slows any itself."""
    e, slow = edge(spark, sf), slowdowns(spark, sf)
    act, hopped = lk.activated(e, [0, 1, 2], [-1, 0]), lk.one_hop_routes(e).where(F.size("routes") > 0)
    causes = lk.causes_slowdown(act, slow).withColumn("c", F.lit(True))
    return lk.residual_slowdown(act, slow, [0, 1, 2], [-1, 0], hopped).join(causes, ["dest", "src"], "left").select("dest", "src", "sl", F.coalesce("c", F.lit(False)).alias("causes"))


@query("tf2_device_subsets", "SELECT c AS \"case\", list_filter(range(5), lambda k: (c >> k::INT) & 1 = 1)::INT[]::VARCHAR AS units FROM range(1, 32) x(c) WHERE bit_count(c) <= 3")
def tf2_device_subsets(spark, sf):
    return tn.device_subsets(spark, 5, 3).select("case", F.concat(F.lit("["), F.array_join(F.col("units").cast("array<string>"), ", "), F.lit("]")).alias("units"))


@query("tf3_permutations", "WITH u AS (SELECT k FROM range(4) x(k)) SELECT row_number() OVER (ORDER BY a.k, b.k, c.k, d.k)::INT - 1 AS place, a.k || ',' || b.k || ',' || c.k || ',' || d.k AS units FROM u a, u b, u c, u d WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND b.k <> c.k AND b.k <> d.k AND c.k <> d.k")
def tf3_permutations(spark, sf):
    return tn.permutations(spark, 4).select("place", F.array_join(F.col("units").cast("array<string>"), ",").alias("units"))


@query("tf4_size_ladder", "WITH RECURSIVE l AS (SELECT 256::BIGINT AS T, 256::BIGINT AS step UNION ALL SELECT T + step, CASE WHEN T + step >= 16 * step THEN step * 2 ELSE step END FROM l WHERE T + step <= 16384) SELECT T, step FROM l")
def tf4_size_ladder(spark, sf):
    """Benchmark sizes: the step doubles at 16 steps."""
    return spark.sql("WITH RECURSIVE l(T, step) AS (SELECT 256L, 256L UNION ALL SELECT T + step, CASE WHEN T + step >= 16 * step THEN step * 2 ELSE step END FROM l WHERE T + step <= 16384) SELECT T, step FROM l")


@query("tf5_evaluation_grid", "WITH loc AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 1), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 1, 0), (0, 1, 2)) v(a_loc, b_loc, c_loc)), s AS (SELECT m AS M, m AS N, m AS K FROM range(2048, 22529, 1024) x(m) UNION ALL SELECT m, m, m // k FROM range(8192, 32769, 4096) x(m), (VALUES (2), (8), (32)) r(k) UNION ALL SELECT k // q, k // q, k FROM range(12288, 36865, 4096) x(k), (VALUES (2), (8), (32)) r(q)) SELECT a_loc, b_loc, c_loc, M, N, K FROM loc, s")
def tf5_evaluation_grid(spark, sf):
    """Ten location triples by square, thin and fat problems."""
    locs = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 1, 0), (0, 1, 2)], "a_loc int, b_loc int, c_loc int")
    m, ratios = F.col("id"), F.explode(F.array(F.lit(2), F.lit(8), F.lit(32))).alias("q")
    square = spark.range(2048, 22529, 1024).select(m.alias("M"), m.alias("N"), m.alias("K"))
    thin = spark.range(8192, 32769, 4096).select("id", ratios).select(m.alias("M"), m.alias("N"), F.expr("id div q").alias("K"))
    fat = spark.range(12288, 36865, 4096).select("id", ratios).select(F.expr("id div q").alias("M"), F.expr("id div q").alias("N"), m.alias("K"))
    return locs.crossJoin(square.union(thin).union(fat))


QUOTA_SQL = f"""{PROB_SQL}, sc AS (SELECT DISTINCT (D1 // 512 * (D2 // 512) * 3)::BIGINT AS n, (D1 // 512 % 3)::INT AS kind FROM prob), scores AS (SELECT n, kind, n * 10 + kind AS pid, v.unit, v.s[kind + 1] AS score FROM sc, (VALUES (0, [0.5, 0.1, 0.25]), (1, [0.3, 0.0, 0.25]), (2, [0.2, 0.9, 0.5])) v(unit, s)),
base AS (SELECT *, floor(round(score::DOUBLE * n, 9))::BIGINT AS base FROM scores), q0 AS (SELECT *, n - sum(base) OVER (PARTITION BY pid) AS lft, row_number() OVER (PARTITION BY pid ORDER BY unit) AS place FROM base),
quota AS (SELECT pid, unit, (base + lft // 3 + CASE WHEN place <= lft % 3 THEN 1 ELSE 0 END)::BIGINT AS quota FROM q0)"""


def scores(spark, sf):
    sc = problems(spark, sf).select((F.expr("D1 div 512") * F.expr("D2 div 512") * 3).alias("n"), (F.expr("D1 div 512") % 3).cast("int").alias("kind")).distinct()
    v = spark.createDataFrame([(0, [0.5, 0.1, 0.25]), (1, [0.3, 0.0, 0.25]), (2, [0.2, 0.9, 0.5])], "unit int, s array<double>")
    return sc.join(F.broadcast(v)).select((F.col("n") * 10 + F.col("kind")).alias("pid"), "unit", F.element_at("s", F.col("kind") + 1).alias("score"), "n")


@query("ds6_quotas", f"WITH {QUOTA_SQL} SELECT pid, unit, quota FROM quota WHERE quota > 0")
def ds6_quotas(spark, sf):
    """Whole parts, then one more in order; idle units dropped."""
    return tn.quotas(scores(spark, sf)).where("quota > 0")


ORDERS = {"ds1_round_robin": ("round_robin", 1, "slot, unit"), "ds2_contiguous": ("contiguous", 1, "unit, slot"), "ds3_chunked": ("chunked", 4, "slot // 4, unit, slot"), "ds4_chunked_reverse": ("chunked_reverse", 4, "slot // 4, unit, CASE WHEN unit % 2 = 0 THEN -(slot % 4) ELSE slot % 4 END")}
for _name, (_strategy, _chunk, _order) in ORDERS.items():
    _sql = f"WITH {QUOTA_SQL}, sl AS (SELECT pid, unit, unnest(range(quota)) AS slot FROM quota WHERE quota > 0) SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY {_order}) - 1 AS sk, unit, slot FROM sl"

    @query(_name, _sql)
    def distribution(spark, sf, strategy=_strategy, chunk=_chunk):
        """Tasks to units by quota and strategy."""
        return tn.distribute(tn.quotas(scores(spark, sf)), strategy, chunk)


@query("ord5_closest_units", f"WITH {LINK_SQL}, k AS (SELECT dest, src, bw, row_number() OVER (PARTITION BY dest ORDER BY bw DESC, src) AS p FROM edge WHERE dest <> src) SELECT dest, src, bw, greatest(0, least(1, 2.5 - (p - 1)))::DOUBLE AS share FROM k")
def ord5_closest_units(spark, sf):
    return tn.closest_units(edge(spark, sf).where("dest <> src"), 2.5)


@query("ord7_task_selection", f"WITH {PROB_SQL}, e AS (SELECT unit, pid AS sk, round(score, 1) AS eta, D1 // 512 AS fired, D2 // 512 AS local_tiles, loc_b * 0.5::DOUBLE AS penalty FROM prob) SELECT unit, arg_min(sk, (eta, -fired, sk)) AS by_eta, arg_min(sk, (-local_tiles, sk)) AS by_local, min(sk) AS serial, arg_min(sk, (eta + penalty, sk)) AS by_cost FROM e GROUP BY unit")
def ord7_task_selection(spark, sf):
    """Each unit's next task by the four rules."""
    ready = problems(spark, sf).select("unit", F.col("pid").alias("sk"), F.round("score", 1).alias("eta"), F.expr("D1 div 512").alias("fired"), F.expr("D2 div 512").alias("local_tiles"), (F.col("loc_b") * 0.5).alias("penalty"))
    one = lambda rule, name: tn.select_task(ready, rule).withColumnRenamed("sk", name)
    return one("eta", "by_eta").join(one("local", "by_local"), "unit").join(one("serial", "serial"), "unit").join(one("cost", "by_cost"), "unit")


@query("ag26_data_locations", f"WITH {PROB_SQL}, o AS (SELECT pid, unnest([loc_a, loc_b, loc_c]) AS loc FROM prob), c AS (SELECT pid, loc, count(*) AS n FROM o GROUP BY ALL) SELECT pid, string_agg(loc::VARCHAR, ',' ORDER BY loc) AS locs, arg_max(loc, (n, (loc * 3 + 1) % 4, loc)) AS main FROM c GROUP BY pid")
def ag26_data_locations(spark, sf):
    """Distinct operand locations, and the one of most operands; ties go to the slower receive."""
    o = problems(spark, sf).select("pid", F.explode(F.array("loc_a", "loc_b", "loc_c")).alias("loc")).groupBy("pid", "loc").agg(F.count("*").alias("n"))
    g = o.groupBy("pid").agg(F.array_sort(F.collect_set("loc")).alias("l"), F.max_by("loc", F.struct("n", (F.col("loc") * 3 + 1) % 4, "loc")).alias("main"))
    return g.select("pid", F.array_join(F.col("l").cast("array<string>"), ",").alias("locs"), "main")


@query("ag28_near_values", """WITH RECURSIVE v AS (SELECT p_brand, p_size, p_retailprice AS x, count(*) AS n FROM part GROUP BY ALL),
g AS (SELECT p_brand, p_size, min(x) AS lo, min(x) AS pv FROM v GROUP BY ALL UNION ALL
SELECT p_brand, p_size, nx, CASE WHEN nx - mean < 0.05::DOUBLE * mean THEN mean ELSE nx END FROM (SELECT g.p_brand, g.p_size,
 (SELECT sum(x * n) / sum(n) FROM v WHERE v.p_brand = g.p_brand AND v.p_size = g.p_size AND x >= lo AND x - pv < 0.05::DOUBLE * pv) AS mean,
 (SELECT min(x) FROM v WHERE v.p_brand = g.p_brand AND v.p_size = g.p_size AND x >= lo AND NOT x - pv < 0.05::DOUBLE * pv) AS nx FROM g) WHERE nx IS NOT NULL),
w AS (SELECT v.*, (SELECT max(lo) FROM g WHERE g.p_brand = v.p_brand AND g.p_size = v.p_size AND lo <= x) AS lo FROM v)
SELECT p_brand, p_size, x AS p_retailprice, n, round(sum(x * n) OVER (PARTITION BY p_brand, p_size, lo) / sum(n) OVER (PARTITION BY p_brand, p_size, lo), 6) + 0.0 AS averaged FROM w""")
def ag28_near_values(spark, sf):
    """Prices of each brand's parts by size, values nearer than 5 % to a pivot averaged."""
    g = near_value_means(table(spark, sf, "part"), ["p_brand", "p_size"], "p_retailprice")
    return g.withColumn("averaged", r("averaged"))


@query("set4_unit_sets", f"WITH {PROB_SQL} SELECT pid, list_sort(list_distinct(list_concat([unit, 3], [loc_a, loc_b])))::VARCHAR AS units, list_contains([loc_a, loc_b], unit) AS own FROM prob")
def set4_unit_sets(spark, sf):
    """Units and data locations together; whether a unit holds data."""
    u = F.array_sort(F.array_union(F.array("unit", F.lit(3)), F.array("loc_a", "loc_b")))
    return problems(spark, sf).select("pid", F.concat(F.lit("["), F.array_join(u.cast("array<string>"), ", "), F.lit("]")).alias("units"), F.array_contains(F.array("loc_a", "loc_b"), F.col("unit")).alias("own"))


@query("jn13_task_binding", f"WITH {QUOTA_SQL}, sl AS (SELECT pid, unit, unnest(range(quota)) AS slot FROM quota WHERE quota > 0), b AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY slot, unit) - 1 AS sk, unit FROM sl) SELECT pid, unit, count(*) AS tasks, min(sk) AS first_sk, max(sk) AS last_sk FROM b GROUP BY ALL")
def jn13_task_binding(spark, sf):
    """Sub-kernels joined to the units they were given."""
    s = scores(spark, sf)
    bound = tn.distribute(tn.quotas(s), "round_robin").select("pid", "sk", "unit")
    tasks = s.select("pid", "n").distinct().select("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sk"))
    return tasks.join(bound, ["pid", "sk"]).groupBy("pid", "unit").agg(F.count("*").alias("tasks"), F.min("sk").alias("first_sk"), F.max("sk").alias("last_sk"))
