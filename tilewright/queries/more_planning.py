"""Further predictors, grids and log scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewright.functions import metrics as mt
from tilewright.operators import ordering as od
from tilewright.plans import links as lk
from tilewright.plans import models as cm
from tilewright.plans import tuner as tn
from tilewright.queries import planning as pl
from tilewright.queries.ingest import BENCH_SQL, FULL_SQL, bench, full_log
from tilewright.queries.registry import query, r, table
from tilewright.queries.run_log import LOG_SQL, log
from tilewright.queries.transfers import TRACE_SQL, trace
from tilewright.sources import logs, sinks
from tilewright.sources.paths import scratch



@query("cm22_stream_bytes", f"WITH {pl.PROB_SQL}, s AS (SELECT pid, [8 * D1 * D3, 8 * D3 * D2, 8 * D1 * D2] AS s, [loc_a > 0, loc_b > 0, loc_c > 0] AS f FROM prob) SELECT pid, list_sum(s)::BIGINT AS all_, list_sum([CASE WHEN f[1] THEN s[1] ELSE 0 END, CASE WHEN f[2] THEN s[2] ELSE 0 END, CASE WHEN f[3] THEN s[3] ELSE 0 END])::BIGINT AS remote, list_sum(list_transform(s, lambda x: ceil(x / 1000000.0)::BIGINT * 1000000))::BIGINT AS tiles FROM s")
def cm22_stream_bytes(spark, sf):
    """Bytes of the streams model: all operands, remote ones, all in tiles of a megabyte. With the times of its tile lookup: ``cm21_streams``."""
    sizes = F.array(8 * F.col("D1") * F.col("D3"), 8 * F.col("D3") * F.col("D2"), 8 * F.col("D1") * F.col("D2"))
    remote = F.array(F.col("loc_a") > 0, F.col("loc_b") > 0, F.col("loc_c") > 0)
    one = lambda policy: cm.stream_bytes(policy, sizes, remote, F.lit(1000000))
    return pl.problems(spark, sf).select("pid", one("all").alias("all_"), one("remote").alias("remote"), one("tile").alias("tiles"))


@query("cm29_task_counts", f"WITH {pl.PROB_SQL} SELECT pid, ceil(D1::DOUBLE / T_in)::BIGINT AS level1, ceil(D1::DOUBLE / T_in)::BIGINT * ceil(D2::DOUBLE / T_in)::BIGINT AS level2, ceil(D1::DOUBLE / T_in)::BIGINT * ceil(D2::DOUBLE / T_in)::BIGINT * ceil(D3::DOUBLE / T_in)::BIGINT AS level3, 256 AS low1, 1024 AS low3, least(D1, D2, D3) AS high FROM prob")
def cm29_task_counts(spark, sf):
    """Tasks and allowed tiles by level."""
    t = F.col("T_in")
    low1, _ = cm.allowed_tiles(1, F.lit(256), F.col("D1"))
    low3, high = cm.allowed_tiles(3, F.lit(256), F.col("D1"), F.col("D2"), F.col("D3"))
    return pl.problems(spark, sf).select("pid", cm.task_count(t, F.col("D1")).alias("level1"), cm.task_count(t, F.col("D1"), F.col("D2")).alias("level2"), cm.task_count(t, F.col("D1"), F.col("D2"), F.col("D3")).alias("level3"), low1.alias("low1"), low3.alias("low3"), high.alias("high"))


@query("lm7_routes_via", f"""WITH {pl.LINK_SQL}, e AS (SELECT * FROM edge WHERE dest <> src), v AS (SELECT a.src, b.dest, a.dest AS u, 0.8::DOUBLE * least(a.bw, b.bw) AS hop FROM e a JOIN e b ON b.src = a.dest AND b.dest <> a.src),
k AS (SELECT v.*, max(hop) OVER (PARTITION BY v.dest, v.src) AS top, e.bw FROM v JOIN e ON e.dest = v.dest AND e.src = v.src WHERE hop > e.bw),
x AS (SELECT dest, src, any_value(top) AS top, list(u ORDER BY u) AS routes FROM k WHERE hop = top GROUP BY ALL)
SELECT e.dest, e.src, CASE WHEN x.routes IS NULL OR list_contains(x.routes, 1) THEN e.bw ELSE x.top END AS bw, CASE WHEN x.routes IS NULL OR list_contains(x.routes, 1) THEN '' ELSE array_to_string(x.routes, ',') END AS routes,
(e.dest = 1 OR e.src = 1 OR coalesce(list_contains(x.routes, 1), FALSE)) AS met FROM e LEFT JOIN x ON x.dest = e.dest AND x.src = e.src""")
def lm7_routes_via(spark, sf):
    """Detours that pass at unit 1 ended, and which links end at it or passed there."""
    edges = pl.edge(spark, sf)
    routes = lk.one_hop_routes(edges)
    met = lk.routes_via(routes, 1).select("dest", "src", F.lit(True).alias("met"))
    ended = lk.without_routes_via(routes, edges, 1).join(met, ["dest", "src"], "left")
    return ended.select("dest", "src", "bw", F.array_join(F.col("routes").cast("array<string>"), ",").alias("routes"), F.coalesce("met", F.lit(False)).alias("met"))


@query("lm7_reset", f"WITH {pl.LINK_SQL} SELECT dest, src, bw, 0.0::DOUBLE AS bw_shared, -1 AS active, 0 AS hops FROM edge")
def lm7_reset(spark, sf):
    """A map with shares, activity and routes taken back."""
    return lk.reset(lk.activated(pl.edge(spark, sf), [0, 1], [-1])).select("dest", "src", "bw", "bw_shared", "active", F.size("routes").alias("hops"))


@query("lm8_load_stats", f"WITH {pl.LINK_SQL}, {TRACE_SQL}, fl AS (SELECT dest, src, sum(bytes)::BIGINT AS b FROM trace WHERE dest < 4 AND src < 4 GROUP BY ALL), t AS (SELECT coalesce(b, 0) / (bw * 1e9) AS eta FROM edge e LEFT JOIN fl ON fl.dest = e.dest AND fl.src = e.src) SELECT round(max(eta), 9) + 0.0 AS most, round(avg(eta), 9) + 0.0 AS mean, round(var_pop(eta), 9) + 0.0 AS variance FROM t")
def lm8_load_stats(spark, sf):
    """How uneven the links' loads are."""
    s = lk.load_stats(lk.link_load(trace(spark, sf).where("dest < 4 AND src < 4"), pl.edge(spark, sf)))
    return s.select(*(r(c, 9).alias(c) for c in s.columns))


@query("lm8_link_load", f"WITH {pl.LINK_SQL}, {TRACE_SQL}, fl AS (SELECT dest, src, sum(bytes)::BIGINT AS b FROM trace WHERE dest < 4 AND src < 4 GROUP BY ALL) SELECT e.dest, e.src, coalesce(b, 0)::BIGINT AS bytes, round(coalesce(b, 0) / (bw * 1e9), 9) + 0.0 AS eta FROM edge e LEFT JOIN fl ON fl.dest = e.dest AND fl.src = e.src")
def lm8_link_load(spark, sf):
    """Bytes and time to completion of each link under the trace."""
    t = trace(spark, sf).where("dest < 4 AND src < 4")
    return lk.link_load(t, pl.edge(spark, sf)).select("dest", "src", "bytes", r("eta", 9).alias("eta"))


@query("lm8_rebalanced")
def lm8_rebalanced(spark, sf):
    """Detours chosen by estimated time in a bounded number of rounds; checked against a loop in tests."""
    t = trace(spark, sf).where("dest < 4 AND src < 4").select("dest", "src", "bytes")
    return lk.rebalanced(t, pl.edge(spark, sf))


@query("lm8_balanced_flows", f"WITH {pl.LINK_SQL}, {TRACE_SQL}, e AS (SELECT dest, src FROM edge WHERE dest <> src AND bw > 0) SELECT t.dest, t.src, sum(t.bytes)::BIGINT AS bytes, TRUE AS kept, TRUE AS on_links, TRUE AS fell FROM trace t WHERE t.dest <> t.src AND EXISTS (SELECT 1 FROM e WHERE e.dest = t.dest AND e.src = t.src) GROUP BY ALL")
def lm8_balanced_flows(spark, sf):
    """Each pair of the trace that a link joins, balanced over all links: whether its flows add up, go over links, and the objective fell in every round."""
    links = pl.edge(spark, sf).select("dest", "src", "bw")
    moved = trace(spark, sf).select("dest", "src", "bytes").join(links.select("dest", "src"), ["dest", "src"], "left_semi")
    flows, objective = lk.balanced(moved, links, rounds=6)
    known = lk.one_hop_paths(links).select("dest", "src", F.coalesce("via", F.lit(-9)).alias("over"), F.lit(True).alias("known"))
    met = flows.withColumn("over", F.coalesce("via", F.lit(-9))).join(known, ["dest", "src", "over"], "left")
    whole = F.abs(F.sum("share") - 1) < 1e-9
    fell = all(b <= a * (1 + 1e-12) for a, b in zip(objective, objective[1:]))
    return met.groupBy("dest", "src", "bytes").agg(whole.alias("kept"), F.every(F.coalesce("known", F.lit(False))).alias("on_links"), F.lit(fell).alias("fell"))


@query("jn2_reuse_join", f"""WITH {LOG_SQL}, p AS (SELECT M, N, K, T, a_loc, b_loc, c_loc, dev_num, imp, round((2.0::DOUBLE * M * N * K / 7e12 + 8.0::DOUBLE * M * K / 13e9) / dev_num + CASE imp WHEN 'N' THEN seq % 2 * 1e-3::DOUBLE ELSE 0 END, 9) AS streams, timer FROM log),
a AS (SELECT M, N, K, T, a_loc, b_loc, c_loc, dev_num, streams, min(timer) AS reuse FROM p WHERE imp = 'A' GROUP BY ALL), b AS (SELECT M, N, K, T, a_loc, b_loc, c_loc, dev_num, streams, min(timer) AS no_reuse FROM p WHERE imp = 'N' GROUP BY ALL)
SELECT M, N, K, T, a_loc, b_loc, c_loc, dev_num, streams, reuse, no_reuse FROM a JOIN b USING (M, N, K, T, a_loc, b_loc, c_loc, dev_num, streams)""")
def jn2_reuse_join(spark, sf):
    """Reuse and no-reuse predictions side by side. One key is the streams model's time, a float: equal to nine places."""
    c = F.col
    streams = (2.0 * c("M") * c("N") * c("K") / 7e12 + 8.0 * c("M") * c("K") / 13e9) / c("dev_num") + F.when(c("imp") == "N", c("seq") % 2 * 1e-3).otherwise(0.0)
    keys = ["M", "N", "K", "T", "a_loc", "b_loc", "c_loc", "dev_num", "streams"]
    df = log(spark, sf).withColumn("streams", F.round(streams, 9))
    a = df.where("imp = 'A'").groupBy(*keys).agg(F.min("timer").alias("reuse"))
    return a.join(df.where("imp = 'N'").groupBy(*keys).agg(F.min("timer").alias("no_reuse")), keys)


GRID_SQL = """g AS (SELECT l_orderkey, l_partkey, 4096 * (1 + l_suppkey % 4) AS mid, 2 + l_partkey % 4 AS c, l_linenumber % 3 AS kind, (l_linenumber % 2)::INT AS a_loc, (l_partkey % 2)::INT AS b_loc, (l_suppkey % 2)::INT AS c_loc, l_quantity AS t FROM lineitem),
runs AS (SELECT *, CASE kind WHEN 0 THEN mid * c // 2 WHEN 1 THEN mid * 2 // c ELSE mid END AS M, CASE kind WHEN 0 THEN mid * 4 // (c * c) WHEN 1 THEN mid * c * c // 4 ELSE mid + c END AS K FROM g)"""


def grid_runs(spark, sf):
    """Every line item as a run of a square, fat or thin problem of about ``mid`` cubed."""
    c = F.col
    g = table(spark, sf, "lineitem").select((4096 * (1 + c("l_suppkey") % 4)).alias("mid"), (2 + c("l_partkey") % 4).alias("c"), (c("l_linenumber") % 3).alias("kind"), (c("l_linenumber") % 2).cast("int").alias("a_loc"), (c("l_partkey") % 2).cast("int").alias("b_loc"), (c("l_suppkey") % 2).cast("int").alias("c_loc"), c("l_quantity").alias("t"))
    m = F.when(c("kind") == 0, F.expr("mid * c div 2")).when(c("kind") == 1, F.expr("mid * 2 div c")).otherwise(c("mid"))
    k = F.when(c("kind") == 0, F.expr("mid * 4 div (c * c)")).when(c("kind") == 1, F.expr("mid * c * c div 4")).otherwise(c("mid") + c("c"))
    return g.select("*", m.alias("M"), m.alias("N"), k.alias("K"))


@query("flt8_rounding_windows", f"""WITH {GRID_SQL}, w AS (SELECT * FROM (VALUES (1, 1, 1), (0, 0, 0), (0, 1, 1)) l(a_loc, b_loc, c_loc), (VALUES (4096), (8192), (12288)) m(size), (VALUES (3, TRUE), (4, TRUE), (5, TRUE), (3, FALSE), (4, FALSE)) r(ratio, fat))
SELECT M, K, a_loc, count(*) AS runs, round(sum(t), 4) + 0.0 AS t FROM runs WHERE EXISTS (SELECT 1 FROM w WHERE w.a_loc = runs.a_loc AND w.b_loc = runs.b_loc AND w.c_loc = runs.c_loc AND K::DOUBLE * M * M <= size::DOUBLE ** 3 AND (K + 1)::DOUBLE * (M + 1) * (M + 1) >= (size - 1)::DOUBLE ** 3
 AND CASE WHEN fat THEN M >= K * ratio ** 3 / 8 AND M <= (K + 1) * ratio ** 3 / 8 ELSE M >= K * 8 / ratio ** 3 AND M <= (K + 1) * 8 / ratio ** 3 END) GROUP BY ALL""")
def flt8_rounding_windows(spark, sf):
    """Fat and thin problems of given sizes, with room for the rounding of their dimensions."""
    locs = spark.createDataFrame([(1, 1, 1), (0, 0, 0), (0, 1, 1)], "a_loc int, b_loc int, c_loc int")
    runs = grid_runs(spark, sf)
    kept = mt.in_shape_windows(runs, locs, [4096, 8192, 12288], [3, 4, 5], [3, 4])
    return kept.groupBy("M", "K", "a_loc").agg(F.count("*").alias("runs"), r(F.sum("t"), 4).alias("t"))


@query("flt7_admissible", f"WITH {LOG_SQL} SELECT M, N, K, T, count(*) AS runs FROM log WHERE M / 1.5 >= T AND N / 1.5 >= T AND K / 1.5 >= T GROUP BY ALL")
def flt7_admissible(spark, sf):
    """Runs whose tile fits one and a half times in every dimension."""
    c = F.col
    return log(spark, sf).where(mt.admissible(3, c("T"), c("M"), c("N"), c("K"))).groupBy("M", "N", "K", "T").agg(F.count("*").alias("runs"))


@query("flt9_vector_grid", f"WITH {LOG_SQL} SELECT a_loc, b_loc, N, count(*) AS runs FROM log SEMI JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 1)) l(a_loc, b_loc), (VALUES (2048), (6144), (10240)) n(N)) g USING (a_loc, b_loc, N) WHERE N / 64 <= T AND T <= N / 1.5 GROUP BY ALL")
def flt9_vector_grid(spark, sf):
    """The level-1 grid by locations and exact sizes, with its admissible tiles."""
    locs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a_loc int, b_loc int").crossJoin(spark.createDataFrame([(2048,), (6144,), (10240,)], "N long"))
    df = log(spark, sf).join(F.broadcast(locs), ["a_loc", "b_loc", "N"], "left_semi")
    return df.where(mt.admissible(1, F.col("T"), F.col("N"))).groupBy("a_loc", "b_loc", "N").agg(F.count("*").alias("runs"))


@query("flt3_location_triples", f"WITH {LOG_SQL} SELECT a_loc, b_loc, c_loc, count(*) FILTER (M = N AND N < K) AS thin_fat, count(*) AS runs FROM log WHERE (a_loc, b_loc, c_loc) IN ((1, 1, 1), (0, 0, 0), (1, 0, 1)) GROUP BY ALL")
def flt3_location_triples(spark, sf):
    c = F.col
    triple = F.struct("a_loc", "b_loc", "c_loc").cast("struct<a:int,b:int,c:int>")
    wanted = [F.struct(*map(F.lit, x)).cast("struct<a:int,b:int,c:int>") for x in ((1, 1, 1), (0, 0, 0), (1, 0, 1))]
    df = log(spark, sf).where((triple == wanted[0]) | (triple == wanted[1]) | (triple == wanted[2]))
    return df.groupBy("a_loc", "b_loc", "c_loc").agg(F.count_if(mt.shape_class(c("M"), c("N"), c("K")) == "thin-fat").alias("thin_fat"), F.count("*").alias("runs"))


@query("ord2_labelled_order", f"WITH {LOG_SQL}, g AS (SELECT imp, 100 * (a_loc + 1) + 10 * (b_loc + 1) + (c_loc + 1) AS loc, count(*) AS runs FROM log GROUP BY ALL) SELECT row_number() OVER (ORDER BY imp, loc)::INT AS place, imp, loc, runs FROM g")
def ord2_labelled_order(spark, sf):
    """Groups in order of implementation and location."""
    g = log(spark, sf).groupBy("imp", mt.location_code(F.col("a_loc"), F.col("b_loc"), F.col("c_loc")).alias("loc")).agg(F.count("*").alias("runs"))
    return od.ranked(g, [], [F.col("imp"), F.col("loc")], "place").select(F.col("place").cast("int").alias("place"), "imp", "loc", "runs")


@query("ord6_representative", f"WITH {LOG_SQL} SELECT imp, arg_min(seq, (timer, seq, T, dev_num)) AS seq, min(timer) AS timer FROM log GROUP BY imp")
def ord6_representative(spark, sf):
    """One row for each implementation, after an explicit order."""
    return log(spark, sf).groupBy("imp").agg(F.min_by("seq", F.struct("timer", "seq", "T", "dev_num")).alias("seq"), F.min("timer").alias("timer"))


@query("ord11_launch_replay", f"WITH {pl.QUOTA_SQL}, sl AS (SELECT pid, unit, unnest(range(quota)) AS slot FROM quota WHERE quota > 0), b AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY slot, unit) - 1 AS sk, unit FROM sl) SELECT pid, unit, sk, row_number() OVER (PARTITION BY pid, unit ORDER BY sk) - 1 AS launch FROM b")
def ord11_launch_replay(spark, sf):
    """The order in which each unit launches its tasks, as the first run records it."""
    bound = tn.distribute(tn.quotas(pl.scores(spark, sf)), "round_robin")
    return bound.select("pid", "unit", "sk", (F.row_number().over(W.partitionBy("pid", "unit").orderBy("sk")) - 1).cast("long").alias("launch"))


TF6 = """f AS (SELECT * FROM (VALUES ('N'), ('T')) a(trans_a), (VALUES ('N'), ('T')) b(trans_b), (SELECT 512 * k AS T FROM range(1, 33) x(k)) t, (SELECT 4096 * s AS size FROM range(1, 5) y(s)) s),
l AS (SELECT * FROM (VALUES (-1), (0)) a(a_loc), (VALUES (-1), (0)) b(b_loc), (VALUES (-1), (0)) c(c_loc))"""


@query("tf6_validation_grid", f"""WITH {TF6} SELECT trans_a, trans_b, T, size AS M, size AS N, size AS K, a_loc, b_loc, c_loc FROM f, l
UNION ALL SELECT trans_a, trans_b, T, size * c // 2, size * c // 2, size * 4 // c // c, -1, -1, -1 FROM f, (VALUES (3), (4), (5)) r(c)
UNION ALL SELECT trans_a, trans_b, T, size * 2 // c, size * 2 // c, size * c * c // 4, -1, -1, -1 FROM f, (VALUES (3), (4), (5)) r(c)""")
def tf6_validation_grid(spark, sf):
    """Square problems by flags, tiles and locations on unit 0 or the host; fat and thin ones from the host."""
    e = lambda *x: F.explode(F.array(*map(F.lit, x)))
    by = lambda k: F.explode(F.sequence(F.lit(k).cast("long"), F.lit(16384).cast("long"), F.lit(k).cast("long")))
    f = spark.range(1).select(e("N", "T").alias("trans_a")).select("*", e("N", "T").alias("trans_b")).select("*", by(512).alias("T")).select("*", by(4096).alias("size"))
    dims = lambda df, m, k: df.select("trans_a", "trans_b", "T", m.alias("M"), m.alias("N"), k.alias("K"), *(c for c in ("a_loc", "b_loc", "c_loc")))
    square = f.select("*", e(-1, 0).alias("a_loc")).select("*", e(-1, 0).alias("b_loc")).select("*", e(-1, 0).alias("c_loc"))
    ratios = f.select("*", e(3, 4, 5).alias("c"), *(F.lit(-1).alias(x) for x in ("a_loc", "b_loc", "c_loc")))
    fat = dims(ratios, F.expr("size * c div 2"), F.expr("size * 4 div c div c"))
    return dims(square, F.col("size"), F.col("size")).unionByName(fat).unionByName(dims(ratios, F.expr("size * 2 div c"), F.expr("size * c * c div 4")))


@query("tf7_targeted_grid", "SELECT m AS M, m // q AS K, q AS ratio FROM range(2048, 19458, 1024) x(m), range(3, 11) y(q)")
def tf7_targeted_grid(spark, sf):
    g = spark.range(2048, 19458, 1024).select(F.col("id").alias("M"), F.explode(F.sequence(F.lit(3).cast("long"), F.lit(10).cast("long"))).alias("ratio"))
    return g.select("M", F.expr("M div ratio").alias("K"), "ratio")


@query("tf8_hetero_grid", "SELECT m AS M, m AS N, m AS K FROM range(2048, 22529, 2048) x(m)")
def tf8_hetero_grid(spark, sf):
    m = F.col("id")
    return spark.range(2048, 22529, 2048).select(m.alias("M"), m.alias("N"), m.alias("K"))


@query("src7_link_benchmarks", f"WITH {TRACE_SQL} SELECT dest, src, 64 AS dim1, (64 + event_id % 7)::INT AS dim2, (64 * (64 + event_id % 7) * 8)::BIGINT AS bytes, round(transfer_t, 9) + 0.0 AS transfer_t FROM m")
def src7_link_benchmarks(spark, sf):
    """Link benchmarks, a folder for each pair of ends; ends from the names, bytes from the dimensions."""
    from tilewright.operators.traces import transfer_metrics

    path = scratch(spark, "linkbench")
    m = transfer_metrics(trace(spark, sf))
    rows = m.select(F.format_string("linkbench_to-%d_from-%d_1.2.log", "dest", "src").alias("log"), F.lit(64).alias("dim1"), (64 + F.col("event_id") % 7).cast("int").alias("dim2"), F.col("transfer_t"), F.lit(0.01).alias("error"), F.lit(10).alias("reps"), F.lit(1.0).alias("benchmark_t"), F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt"))
    rows.repartition("log", "salt").drop("salt").write.partitionBy("log").csv(path)
    return logs.read_links(spark, path).select("dest", "src", "dim1", "dim2", "bytes", r("transfer_t", 9).alias("transfer_t"))


@query("src8_link_overlap", f"WITH {TRACE_SQL} SELECT dest, src, (event_id % 4)::INT AS odest, (event_id % 3)::INT AS osrc, count(*) AS runs, round(avg(pipe_t / nullif(transfer_t, 0)), 6) + 0.0 AS sl FROM m GROUP BY ALL")
def src8_link_overlap(spark, sf):
    """Overlap benchmarks, and the slowdown that each other link causes."""
    from tilewright.operators.traces import transfer_metrics

    path = scratch(spark, "overlap")
    m = transfer_metrics(trace(spark, sf))
    rows = m.select(F.format_string("Overlap_to-%d_from-%d_1.2.log", "dest", "src").alias("log"), (F.col("event_id") % 4).alias("a"), (F.col("event_id") % 3).alias("b"), "transfer_t", "pipe_t", F.lit(10), F.lit(1.0), F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt"))
    rows.repartition("log", "salt").drop("salt").write.partitionBy("log").csv(path)
    back = logs.read_links(spark, path, "link_overlap")
    return back.groupBy("dest", "src", F.col("over_loc_dest").alias("odest"), F.col("over_loc_src").alias("osrc")).agg(F.count("*").alias("runs"), r(F.avg(F.try_divide(F.col("over_transfer_t"), F.col("transfer_t")))).alias("sl"))


@query("src12_prediction_log", f"WITH {FULL_SQL} SELECT dev_num - 1 AS dev, 'Dgemm' AS func, trans_a, trans_b, M, N, K, a_loc, b_loc, c_loc, T, round(timer, 6) + 0.0 AS t_pred FROM run WHERE dev_num <= 2")
def src12_prediction_log(spark, sf):
    """The 20-column prediction log filtered by model; 11 columns kept, the packed prediction split."""
    path = scratch(spark, "predictions")
    c = F.col
    model = F.when(c("dev_num") <= 2, "reuse").otherwise("baseline")
    rows = full_log(spark, sf).select(
        model.alias("model"), (c("dev_num") - 1).alias("dev"), F.lit("Dgemm").alias("func"), F.lit("L3").alias("flag0"), "trans_a", "trans_b", "M", "N", "K", "a_loc", "b_loc", "c_loc", c("a_loc").alias("a_out"), c("b_loc").alias("b_out"), "c_out_loc",
        c("M").alias("lda"), c("K").alias("ldb"), c("M").alias("ldc"), F.format_string("[%d|0.5|%s]", "T", c("timer").cast("string")).alias("pred"), F.lit(0.001).alias("inference_t"))
    rows.write.csv(path)
    kept = logs.read(spark, path, "prediction").where("model = 'reuse'").select(*logs.KEPT["prediction"])
    tile, _, pred = mt.struct_fields(c("pred"))
    return kept.select("dev", "func", "trans_a", "trans_b", "M", "N", "K", "a_loc", "b_loc", "c_loc", tile.alias("T"), r(pred).alias("t_pred"))


@query("src14_evaluation_log", f"WITH {FULL_SQL} SELECT M, N, K, a_loc, b_loc, c_loc, dev_num, timer, round(M * N * (2 * K + 1) * 1e-9 / timer / 1024, 6) + 0.0 AS tflops FROM run")
def src14_evaluation_log(spark, sf):
    """Eight columns by position, and the rate the evaluation plots."""
    path = scratch(spark, "evaluation")
    sinks.append_run_log(full_log(spark, sf), path)
    c = F.col
    back = logs.read(spark, path, "run18", "evaluation")
    return back.select("*", r(mt.rate(mt.flops_evaluation(c("M"), c("N"), c("K")), c("timer"), 1024.0)).alias("tflops"))


@query("src2_lower_lookups", f"WITH {BENCH_SQL} SELECT 2 AS level, trans_a, M AS T, round(t, 6) + 0.0 AS mean_t, w::DOUBLE AS w_avg FROM b UNION ALL SELECT 1, NULL, M, round(t, 6) + 0.0, w::DOUBLE FROM b")
def src2_lower_lookups(spark, sf):
    """Level 2 and level 1 lookup tables by their own schemas."""
    c = F.col
    tail = ["mean_t", "w_avg", F.lit(-1.0).alias("j"), F.lit(0.01).alias("e"), F.lit(11).alias("n"), F.lit(1.5).alias("b")]
    two, one = scratch(spark, "lookup2"), scratch(spark, "lookup1")
    bench(spark, sf).select("trans_a", "M", c("M").alias("cols"), *tail).write.csv(two)
    bench(spark, sf).select("M", *tail).write.csv(one)
    l2 = logs.read(spark, two, "lookup_l2").select(F.lit(2).alias("level"), "trans_a", "T", r("mean_t").alias("mean_t"), "w_avg")
    l1 = logs.read(spark, one, "lookup_l1").select(F.lit(1).alias("level"), F.lit(None).cast("string").alias("trans_a"), "T", r("mean_t").alias("mean_t"), "w_avg")
    return l2.unionByName(l1)


@query("src5_local_link", "SELECT u::INT AS dest, u::INT AS src, 0.0::DOUBLE AS ti, 0.0::DOUBLE AS tb FROM range(-1, 4) x(u)")
def src5_local_link(spark, sf):
    return logs.local_link(list(range(-1, 4)), spark)


@query("prj18_level_of", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1 ELSE 3 END AS level FROM part")
def prj18_level_of(spark, sf):
    """The BLAS level of each routine name."""
    name = F.when(F.col("p_size") % 3 == 0, "Daxpy").when(F.col("p_size") % 3 == 1, "Dgemm").otherwise("Sgemm")
    return table(spark, sf, "part").select("p_partkey", mt.level_of(name).alias("level"))
