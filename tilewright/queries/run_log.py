"""Run-log analytics. The log is derived from every row of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import metrics as mt
from tilewright.functions import student as st
from tilewright.operators import ordering as od
from tilewright.queries.registry import case_sensitive, query, r, table

LOG_SQL = """log AS (SELECT l_orderkey AS seq, 512 * (1 + l_partkey % 4) AS T, (1 + l_linenumber % 4)::INT AS dev_num,
  2048 * (1 + l_suppkey % 5) AS M, 2048 * (1 + l_suppkey % 5) AS N, 2048 * (1 + l_partkey % 5) AS K,
  (l_linenumber % 2)::INT AS a_loc, (l_partkey % 2)::INT AS b_loc, (l_suppkey % 2)::INT AS c_loc,
  l_returnflag AS imp, l_quantity / 16.0 AS timer, l_quantity / 16.0 * (0.5 + l_discount * 10) AS pred_t,
  l_quantity / 16.0 * (0.5 + l_discount * 10) * (1 + l_linenumber % 4) * (100 + 1000 * l_tax) AS pred_J FROM lineitem)"""


def log(spark, sf):
    c = F.col
    t = table(spark, sf, "lineitem")
    timer = c("l_quantity") / 16.0
    pred = timer * (0.5 + c("l_discount") * 10)
    dev = (1 + c("l_linenumber") % 4).cast("int")
    return t.select(
        c("l_orderkey").alias("seq"), (512 * (1 + c("l_partkey") % 4)).alias("T"), dev.alias("dev_num"),
        (2048 * (1 + c("l_suppkey") % 5)).alias("M"), (2048 * (1 + c("l_suppkey") % 5)).alias("N"), (2048 * (1 + c("l_partkey") % 5)).alias("K"),
        (c("l_linenumber") % 2).cast("int").alias("a_loc"), (c("l_partkey") % 2).cast("int").alias("b_loc"), (c("l_suppkey") % 2).cast("int").alias("c_loc"),
        c("l_returnflag").alias("imp"), timer.alias("timer"), pred.alias("pred_t"), (pred * (1 + c("l_linenumber") % 4) * (100 + 1000 * c("l_tax"))).alias("pred_J"),
    )


KEYS = ["T", "dev_num", "M", "N", "K", "a_loc", "b_loc", "c_loc"]
KEY_SQL = ", ".join(KEYS)
LOCS = ["a_loc", "b_loc", "c_loc"]
GROUP_SQL = f"{LOG_SQL}, grp AS (SELECT {KEY_SQL}, imp, avg(timer) AS timer, avg(pred_t) AS pred_t, avg(pred_J) AS pred_J, count(*) AS runs FROM log GROUP BY {KEY_SQL}, imp)"


def grouped(spark, sf):
    """The log averaged over equal descriptors and implementations."""
    return log(spark, sf).groupBy(*KEYS, "imp").agg(F.avg("timer").alias("timer"), F.avg("pred_t").alias("pred_t"), F.avg("pred_J").alias("pred_J"), F.count("*").alias("runs"))


@query("prj_gemm_metrics", f"""WITH {LOG_SQL}, w AS (SELECT avg(pred_J / nullif(pred_t, 0) / dev_num) AS watts FROM log),
d AS (SELECT *, M * N * (2 * K + 2) AS flops, 8 * (M * (N + K) + N * K) AS bytes, timer * watts * dev_num AS joules FROM log, w)
SELECT seq, T, imp, flops, bytes, round(flops / (1e9 * timer), 6) + 0.0 AS perf, round(joules, 9) + 0.0 AS energy, round(flops / (1e9 * joules), 6) + 0.0 AS pdp,
round((flops / (1e9 * timer)) ** 2 / (watts * dev_num), 4) + 0.0 AS edp, 100 * (a_loc + 1) + 10 * (b_loc + 1) + (c_loc + 1) AS loc_code FROM d""")
def prj_gemm_metrics(spark, sf):
    """Work, bytes, rate, energy, power-delay, energy-delay and location code of every run."""
    df = log(spark, sf)
    watts = df.agg(F.avg(F.try_divide(F.try_divide(F.col("pred_J"), F.col("pred_t")), F.col("dev_num"))).alias("watts"))
    df = df.join(F.broadcast(watts)).withColumn("flops", mt.flops_run(F.col("M"), F.col("N"), F.col("K")))
    joules, perf = mt.energy(F.col("timer"), F.col("watts"), F.col("dev_num")), mt.gflops(F.col("flops"), F.col("timer"))
    return df.select(
        "seq", "T", "imp", "flops", mt.gemm_bytes(F.col("M"), F.col("N"), F.col("K")).alias("bytes"), r(perf).alias("perf"), r(joules, 9).alias("energy"), r(mt.power_delay(F.col("flops"), joules)).alias("pdp"),
        r(mt.energy_delay(perf, F.col("watts"), F.col("dev_num")), 4).alias("edp"), mt.location_code(*map(F.col, LOCS)).alias("loc_code"),
    )


@query("prj_flop_formulas", f"""WITH {LOG_SQL} SELECT DISTINCT M, N, K, M * N * (2 * K + 2) AS run, M * N * (2 * K + 1) AS evaluation, 2 * M * N * K AS roofline,
floor(cbrt(M::DOUBLE * N * K) / 1000 + 1e-12)::BIGINT AS size, CASE WHEN M = N AND N = K THEN 'square' WHEN M = N AND N > K THEN 'fat-thin' WHEN M = N AND N < K THEN 'thin-fat' END AS shape,
M::DOUBLE * N * K >= 4096.0::DOUBLE ** 3 AND M >= 1024 AND N >= 1024 AND K >= 1024 AND M::DOUBLE * N * K < 19457.0::DOUBLE ** 3 AS within, M::DOUBLE * N * K <= 9200.0::DOUBLE ** 3 AS small FROM log""")
def prj_flop_formulas(spark, sf):
    return log(spark, sf).select(
        "M", "N", "K", mt.flops_run(F.col("M"), F.col("N"), F.col("K")).alias("run"), mt.flops_evaluation(F.col("M"), F.col("N"), F.col("K")).alias("evaluation"), mt.flops_roofline(F.col("M"), F.col("N"), F.col("K")).alias("roofline"),
        mt.cube_root_size(F.col("M"), F.col("N"), F.col("K")).alias("size"), mt.shape_class(F.col("M"), F.col("N"), F.col("K")).alias("shape"), mt.within_limits(F.col("M"), F.col("N"), F.col("K")).alias("within"), mt.is_small(F.col("M"), F.col("N"), F.col("K")).alias("small"),
    ).distinct()


@query("prj17_roofline", f"""WITH {LOG_SQL}, d AS (SELECT seq, T, timer, M, N, K, dev_num AS d, a_loc - 1 AS a, b_loc - 1 AS b, c_loc - 1 AS c FROM log),
s AS (SELECT *, 13.0::DOUBLE * least(4, d) AS host, 24.0::DOUBLE * (d - 1) AS peer, 2 * M * N * K / 1e12 AS work FROM d),
t AS (SELECT *, work / (6.9::DOUBLE * d) AS exec_t, 8 * M * K / 1e9 / nullif(CASE WHEN a = -1 THEN host ELSE peer END, 0) + 8 * N * K / 1e9 / nullif(CASE WHEN b = -1 THEN host ELSE peer END, 0) + 8 * M * N / 1e9 / nullif(CASE WHEN c = -1 THEN host ELSE peer END, 0) AS transfer_t FROM s)
SELECT seq, T, timer, round(CASE WHEN transfer_t IS NULL THEN 0 ELSE work / greatest(exec_t, transfer_t) * 0.9::DOUBLE END, 9) + 0.0 AS tflops FROM t""")
def prj17_roofline(spark, sf):
    """Each operand over its own link; locations are host (-1) or a unit."""
    c = F.col
    rate = mt.roofline(c("M"), c("N"), c("K"), c("dev_num"), *(c(x) - 1 for x in LOCS))
    return log(spark, sf).select("seq", "T", "timer", r(rate, 9).alias("tflops"))


@query("prj11_errors", f"""WITH {LOG_SQL}, d AS (SELECT imp, 100 * (pred_t - timer) / nullif(timer, 0) AS pe FROM log), e AS (SELECT imp, pe, round(pe, 9) AS x FROM d)
SELECT imp, round(avg(abs(pe)), 6) + 0.0 AS mape, round(stddev_samp(pe), 6) + 0.0 AS sd, count(*) FILTER (abs(x) > 200) AS beyond,
count(*) FILTER ((x > 55 AND x <= 200) OR (x >= -200 AND x < -50)) AS far, count(*) FILTER ((x > 25 AND x <= 50) OR (x >= -50 AND x < -25)) AS near FROM e GROUP BY imp""")
def prj11_errors(spark, sf):
    """Percentage errors: mean absolute, deviation, and counts by outlier band."""
    error = mt.percentage_error(F.col("pred_t"), F.col("timer"))
    df = log(spark, sf).select("imp", error.alias("pe"), mt.error_band(error).alias("band"))
    return df.groupBy("imp").agg(r(mt.mape(F.col("pe"))).alias("mape"), r(F.stddev_samp("pe")).alias("sd"), *(F.count_if(F.col("band") == b).alias(name) for b, name in ((3, "beyond"), (2, "far"), (1, "near"))))


@query("prj13_packed_struct", "WITH d AS (SELECT event_id, '[' || (user_id % 64) || '|' || (value / 2) || '|' || value || ']' AS p FROM events), s AS (SELECT event_id, string_split(p[2:-2], '|') AS f FROM d) SELECT event_id, f[1]::BIGINT AS T, round(f[2]::DOUBLE, 6) + 0.0 AS ratio, round(f[3]::DOUBLE, 6) + 0.0 AS pred FROM s")
def prj13_packed_struct(spark, sf):
    packed = F.format_string("[%s|%s|%s]", (F.col("user_id") % 64).cast("string"), (F.col("value") / 2).cast("string"), F.col("value").cast("string"))
    df = table(spark, sf, "events").select("event_id", packed.alias("p"))
    tile, ratio, pred = mt.struct_fields(F.col("p"))
    return df.select("event_id", tile.alias("T"), r(ratio).alias("ratio"), r(pred).alias("pred"))


@query("prj14_device_tokens", "WITH d AS (SELECT event_id, (user_id % 6)::INT AS dev, (10 ** (user_id % 6) + 10 ** (event_id % 6))::BIGINT AS token FROM events) SELECT event_id, (10 ** dev)::BIGINT AS own, token, list_filter(range(10), lambda k: (token // (10 ** k)::BIGINT) % 10 > 0)::INT[]::VARCHAR AS devices, (dev <> 0)::INT AS remote FROM d")
def prj14_device_tokens(spark, sf):
    """Base-10 device tokens and back; whether the first device is remote to unit 0."""
    dev = (F.col("user_id") % 6).cast("int")
    df = table(spark, sf, "events").select("event_id", dev.alias("dev"), (mt.device_token(dev) + mt.device_token(F.col("event_id") % 6)).alias("token"))
    listed = F.concat(F.lit("["), F.array_join(mt.devices_of(F.col("token")).cast("array<string>"), ", "), F.lit("]"))
    return df.select("event_id", mt.device_token(F.col("dev")).alias("own"), "token", listed.alias("devices"), mt.remote(F.col("dev"), F.lit(0)).alias("remote"))


@query("prj9_relabel", f"WITH {LOG_SQL} SELECT CASE WHEN imp = 'A' THEN 'baseline' WHEN imp = 'N' AND dev_num > 2 THEN 'multi' ELSE imp END AS label, CASE WHEN a_loc = 1 AND b_loc = 1 AND c_loc = 1 THEN 'full' WHEN greatest(a_loc, b_loc, c_loc) = 1 AND least(a_loc, b_loc, c_loc) = 0 THEN 'partial' ELSE 'none' END AS offload, count(*) AS n FROM log GROUP BY ALL")
def prj9_relabel(spark, sf):
    label = F.when(F.col("imp") == "A", "baseline").when((F.col("imp") == "N") & (F.col("dev_num") > 2), "multi").otherwise(F.col("imp"))
    return log(spark, sf).groupBy(label.alias("label"), mt.offload_class(*map(F.col, LOCS)).alias("offload")).agg(F.count("*").alias("n"))


@query("prj18_levels", "WITH d AS (SELECT ps.f, p_size FROM part, (VALUES ('gemm'), ('gemv'), ('axpy'), ('dot')) ps(f)) SELECT f, p_size, count(*) AS n, CASE f WHEN 'gemm' THEN 2 * p_size * p_size * p_size WHEN 'gemv' THEN 2 * p_size * p_size ELSE 2 * p_size END::BIGINT AS flops FROM d GROUP BY ALL")
def prj18_levels(spark, sf):
    """Work of each routine at every size in ``part``."""
    n = F.col("p_size").cast("long")
    df = table(spark, sf, "part").select("p_size", F.explode(F.array(*map(F.lit, ("gemm", "gemv", "axpy", "dot")))).alias("f"))
    return df.groupBy("f", "p_size", mt.routine_flops(F.col("f"), n, n, n).alias("flops")).agg(F.count("*").alias("n"))


@query("ag1_group_stats", f"WITH {LOG_SQL} SELECT {KEY_SQL}, imp, count(*) AS runs, round(avg(timer), 11) + 0.0 AS mean_t, min(timer) AS min_t, max(timer) AS max_t, round(avg(pred_t), 11) + 0.0 AS mean_pred FROM log GROUP BY {KEY_SQL}, imp")
def ag1_group_stats(spark, sf):
    """Mean, least and greatest of the repetitions of each descriptor."""
    return log(spark, sf).groupBy(*KEYS, "imp").agg(F.count("*").alias("runs"), r(F.avg("timer"), 11).alias("mean_t"), F.min("timer").alias("min_t"), F.max("timer").alias("max_t"), r(F.avg("pred_t"), 11).alias("mean_pred"))


@query("ag5_means", f"""WITH {LOG_SQL}, d AS (SELECT imp, M::DOUBLE * N * K <= 9200.0::DOUBLE ** 3 AS small, M * N * (2 * K + 2) AS flops, timer, M * N * (2 * K + 2) / (1e9 * timer) AS perf FROM log)
SELECT imp, CASE WHEN grouping(small) = 1 THEN 'total' WHEN small THEN 'small' ELSE 'large' END AS size, count(*) AS n, round(avg(perf), 4) + 0.0 AS mean, round(avg(flops) / avg(timer) / 1e9, 4) + 0.0 AS ratio_of_means,
round(count(perf) / sum(1 / perf), 4) + 0.0 AS hmean, round(exp(avg(ln(perf))), 4) + 0.0 AS gmean FROM d GROUP BY GROUPING SETS ((imp, small), (imp))""")
def ag5_means(spark, sf):
    """Arithmetic, ratio, harmonic and geometric means, for small, large and all problems."""
    df = log(spark, sf).withColumn("flops", mt.flops_run(F.col("M"), F.col("N"), F.col("K"))).withColumn("perf", mt.gflops(F.col("flops"), F.col("timer"))).withColumn("small", mt.is_small(F.col("M"), F.col("N"), F.col("K")))
    df = df.groupingSets([["imp", "small"], ["imp"]], "imp", "small").agg(
        F.grouping("small").alias("g"), F.count("*").alias("n"), r(F.avg("perf"), 4).alias("mean"), r(F.try_divide(F.avg("flops"), F.avg("timer")) / 1e9, 4).alias("ratio_of_means"),
        r(mt.harmonic_mean(F.col("perf")), 4).alias("hmean"), r(mt.geometric_mean(F.col("perf")), 4).alias("gmean"))
    return df.select("imp", F.when(F.col("g") == 1, "total").when(F.col("small"), "small").otherwise("large").alias("size"), "n", "mean", "ratio_of_means", "hmean", "gmean")


@query("ag12_state_of_the_art", f"""WITH {LOG_SQL}, p AS (SELECT M, N, K, a_loc, b_loc, c_loc, avg(timer) FILTER (imp = 'A') AS ta, avg(timer) FILTER (imp = 'N') AS tn, avg(timer) FILTER (imp = 'R') AS tr FROM log GROUP BY 1, 2, 3, 4, 5, 6)
SELECT M, N, K, a_loc, b_loc, c_loc, round(ta, 11) + 0.0 AS t_a, round(tn, 11) + 0.0 AS t_n, round(tr, 11) + 0.0 AS t_r, round(least(ta, tn, tr), 11) + 0.0 AS best FROM p""")
def ag12_state_of_the_art(spark, sf):
    """Implementations side by side, and the row's least."""
    own = lambda i: F.avg(F.when(F.col("imp") == i, F.col("timer")))
    p = log(spark, sf).groupBy("M", "N", "K", *LOCS).agg(own("A").alias("ta"), own("N").alias("tn"), own("R").alias("tr"))
    return p.select("M", "N", "K", *LOCS, r("ta", 11).alias("t_a"), r("tn", 11).alias("t_n"), r("tr", 11).alias("t_r"), r(F.least("ta", "tn", "tr"), 11).alias("best"))


@query("ag13_predicted_best", f"""WITH {GROUP_SQL}, b AS (SELECT M, N, K, a_loc, b_loc, c_loc, imp, arg_min(timer, (round(pred_t, 9), T, dev_num)) AS picked, min(timer) AS best,
coalesce(max(CASE WHEN T = 1024 AND dev_num = 2 THEN timer END), arg_max(timer, (T, dev_num))) AS fixed FROM grp GROUP BY ALL)
SELECT M, N, K, a_loc, b_loc, c_loc, imp, round(picked / best, 6) + 0.0 AS achieved, round(fixed / best, 6) + 0.0 AS fixed_ratio FROM b""")
def ag13_predicted_best(spark, sf):
    """Time at the predicted-best plan over the true best; the same for one fixed tile size."""
    g = grouped(spark, sf).groupBy("M", "N", "K", *LOCS, "imp")
    fixed = F.coalesce(F.max(F.when((F.col("T") == 1024) & (F.col("dev_num") == 2), F.col("timer"))), F.max_by("timer", F.struct("T", "dev_num")))
    b = g.agg(F.min_by("timer", F.struct(F.round("pred_t", 9), "T", "dev_num")).alias("picked"), F.min("timer").alias("best"), fixed.alias("fixed"))
    return b.select("M", "N", "K", *LOCS, "imp", r(F.try_divide(F.col("picked"), F.col("best"))).alias("achieved"), r(F.try_divide(F.col("fixed"), F.col("best"))).alias("fixed_ratio"))


@query("ag15_least_squares", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS slope, round(abs(regr_intercept(l_extendedprice, l_quantity)), 5) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) + 0.0 AS r2 FROM lineitem GROUP BY 1")
def ag15_least_squares(spark, sf):
    """A line a group, the intercept's absolute value kept, as for links."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.regr_slope(y, x)).alias("slope"), r(F.abs(F.regr_intercept(y, x)), 5).alias("intercept"), r(F.regr_r2(y, x), 9).alias("r2"))


#: Student's t for every count of ``n``, by bisection of its distribution's finite trigonometric sums; ``counts(n)`` comes before.
STUDENT_SQL = """deg AS (SELECT n, n - 1 AS f, CASE WHEN (n - 1) % 2 = 1 THEN list_transform(range((n - 2) // 2), lambda k: lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE) + lgamma(1.5::DOUBLE))
    ELSE list_transform(range((n - 1) // 2), lambda k: lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(0.5::DOUBLE)) END AS c FROM (SELECT DISTINCT n FROM counts WHERE n >= 2)),
  bisected AS (
    SELECT n, list_reduce([[1.9::DOUBLE, 13.0::DOUBLE]] || list_transform(range(55), lambda i: [0.0::DOUBLE, 0.0::DOUBLE]), lambda b, e: CASE WHEN
      (CASE WHEN f % 2 = 1 THEN 2 / pi() * (atan((b[1] + b[2]) / 2 / sqrt(f)) + sin(atan((b[1] + b[2]) / 2 / sqrt(f))) * coalesce(list_sum(list_transform(c, lambda g, k: exp(g + (2 * k - 1) * ln(cos(atan((b[1] + b[2]) / 2 / sqrt(f))))))), 0))
            ELSE sin(atan((b[1] + b[2]) / 2 / sqrt(f))) * list_sum(list_transform(c, lambda g, k: exp(g + 2 * (k - 1) * ln(cos(atan((b[1] + b[2]) / 2 / sqrt(f))))))) END) > 0.95
      THEN [b[1], (b[1] + b[2]) / 2] ELSE [(b[1] + b[2]) / 2, b[2]] END) AS b FROM deg),
  student AS (SELECT n, (b[1] + b[2]) / 2 AS t FROM bisected)"""


@query("ag17_error_margin", f"""WITH g AS (SELECT l_suppkey, l_linenumber, count(*) AS n, stddev_pop(l_quantity) AS sd, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL), counts AS (SELECT n FROM g), {STUDENT_SQL}
SELECT l_suppkey, l_linenumber, g.n, round(t * sd / sqrt(g.n) / mean, 8) + 0.0 AS margin FROM g LEFT JOIN student USING (n)""")
def ag17_error_margin(spark, sf):
    """Half-width of the 95 % interval, relative to the mean."""
    found = st.error_margins(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], "l_quantity")
    return found.select("l_suppkey", "l_linenumber", "n", r("margin", 8).alias("margin"))


@query("ag17_stopping", f"""WITH x AS (SELECT l_suppkey % 12 AS bench, l_orderkey AS o, l_linenumber AS k, l_quantity AS v FROM lineitem),
w AS (SELECT bench, row_number() OVER o AS n, avg(v) OVER (o ROWS UNBOUNDED PRECEDING) AS mean, stddev_pop(v) OVER (o ROWS UNBOUNDED PRECEDING) AS sd FROM x WINDOW o AS (PARTITION BY bench ORDER BY o, k, v)),
counts AS (SELECT n FROM w WHERE n > 10 AND n <= 1200 AND sd / sqrt(n) / mean <= 0.026), {STUDENT_SQL},
s AS (SELECT bench, w.n, mean, t * sd / sqrt(w.n) / mean AS margin FROM w JOIN student USING (n) WHERE sd / sqrt(w.n) / mean <= 0.026),
f AS (SELECT bench, arg_min(s, n) AS s FROM s WHERE margin <= 0.05 GROUP BY bench)
SELECT b.bench, samples, s.n AS n, round(s.mean, 8) + 0.0 AS mean, round(s.margin, 8) + 0.0 AS margin FROM (SELECT bench, count(*) AS samples FROM x GROUP BY bench) b LEFT JOIN f USING (bench)""")
def ag17_stopping(spark, sf):
    """Where each benchmark's run stops: over 10 samples and a margin of 5 %; the samples are all line items in order, by supplier."""
    runs = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 12).alias("bench"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("v"))
    return st.stopping(runs, ["bench"], ["o", "k"], "v").select("bench", "samples", "n", r("mean", 8).alias("mean"), r("margin", 8).alias("margin"))


@query("ag29_five_numbers", f"WITH {LOG_SQL}, d AS (SELECT imp, 100 * (a_loc + 1) + 10 * (b_loc + 1) + (c_loc + 1) AS loc_code, M * N * (2 * K + 2) / (1e9 * timer) AS perf FROM log) SELECT imp, loc_code, round(min(perf), 4) + 0.0 AS low, round(quantile_cont(perf, 0.25), 4) + 0.0 AS q1, round(quantile_cont(perf, 0.5), 4) + 0.0 AS median, round(quantile_cont(perf, 0.75), 4) + 0.0 AS q3, round(max(perf), 4) + 0.0 AS high FROM d GROUP BY ALL")
def ag29_five_numbers(spark, sf):
    df = log(spark, sf).select("imp", mt.location_code(*map(F.col, LOCS)).alias("loc_code"), mt.gflops(mt.flops_run(F.col("M"), F.col("N"), F.col("K")), F.col("timer")).alias("perf"))
    q = od.quantiles(df, ["imp", "loc_code"], "perf", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("imp", "loc_code", *(r(F.col("q")[k], 4).alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))))


@query("flt4_grid_semi_join", f"""WITH {LOG_SQL}, grid AS (SELECT 2048 * m AS M, 2048 * k AS K, l.* FROM range(2, 5) a(m), range(1, 4) b(k), (VALUES (1, 1, 1), (0, 0, 1), (1, 0, 0), (0, 1, 0)) l(a_loc, b_loc, c_loc))
SELECT imp, M, K, a_loc, b_loc, c_loc, count(*) AS n, round(sum(timer), 4) + 0.0 AS t FROM log SEMI JOIN grid USING (M, K, a_loc, b_loc, c_loc) WHERE M >= 1.5 * T AND T NOT IN (1536) GROUP BY ALL""")
def flt4_grid_semi_join(spark, sf):
    """Runs of an evaluation grid (a semi-join, not an OR tree), with tiles that fit and no excluded sizes."""
    n = lambda a, b, name: F.explode(F.sequence(F.lit(a), F.lit(b))).alias(name)
    locs = spark.createDataFrame([(1, 1, 1), (0, 0, 1), (1, 0, 0), (0, 1, 0)], "a_loc int, b_loc int, c_loc int")
    grid = spark.range(1).select(n(2, 4, "m")).select("m", n(1, 3, "k")).select((2048 * F.col("m")).cast("long").alias("M"), (2048 * F.col("k")).cast("long").alias("K")).crossJoin(locs)
    df = log(spark, sf).join(F.broadcast(grid), ["M", "K", *LOCS], "left_semi").where((F.col("M") >= 1.5 * F.col("T")) & ~F.col("T").isin(1536))
    return df.groupBy("imp", "M", "K", *LOCS).agg(F.count("*").alias("n"), r(F.sum("timer"), 4).alias("t"))


@query("flt1_device_counts", f"WITH {LOG_SQL} SELECT dev_num, count(*) AS n, count(*) FILTER (M = N AND N = K) AS square, count(*) FILTER (M::DOUBLE * N * K <= 9200.0::DOUBLE ** 3) AS small FROM log WHERE dev_num IN (1, 2, 4) GROUP BY 1")
def flt1_device_counts(spark, sf):
    return log(spark, sf).where(F.col("dev_num").isin(1, 2, 4)).groupBy("dev_num").agg(F.count("*").alias("n"), F.count_if((F.col("M") == F.col("N")) & (F.col("N") == F.col("K"))).alias("square"), F.count_if(mt.is_small(F.col("M"), F.col("N"), F.col("K"))).alias("small"))


D = ["M", "N", "K", "a_loc", "b_loc", "c_loc"]


@query("jn1_validation_join", f"""WITH {LOG_SQL}, v AS (SELECT {KEY_SQL}, avg(timer) AS val FROM log WHERE imp <> 'R' GROUP BY ALL), p AS (SELECT {KEY_SQL}, min(pred_t) AS pred FROM log WHERE imp <> 'A' GROUP BY ALL)
SELECT {KEY_SQL}, round(val, 11) + 0.0 AS val, round(pred, 11) + 0.0 AS pred, round(100 * (pred - val) / val, 6) + 0.0 AS error FROM v JOIN p USING ({KEY_SQL})""")
def jn1_validation_join(spark, sf):
    """Measured against predicted values of the same descriptor."""
    df = log(spark, sf)
    v = df.where("imp <> 'R'").groupBy(*KEYS).agg(F.avg("timer").alias("val"))
    p = df.where("imp <> 'A'").groupBy(*KEYS).agg(F.min("pred_t").alias("pred"))
    return v.join(p, KEYS).select(*KEYS, r("val", 11).alias("val"), r("pred", 11).alias("pred"), r(mt.percentage_error(F.col("pred"), F.col("val"))).alias("error"))


@query("jn3_three_way", f"""WITH {LOG_SQL}, g AS (SELECT M, N, K, a_loc, b_loc, c_loc, imp, avg(timer) AS t FROM log GROUP BY ALL)
SELECT a.M, a.N, a.K, a.a_loc, a.b_loc, a.c_loc, round(a.t, 11) + 0.0 AS t_a, round(b.t, 11) + 0.0 AS t_n, round(c.t, 11) + 0.0 AS t_r FROM g a JOIN g b USING (M, N, K, a_loc, b_loc, c_loc) JOIN g c USING (M, N, K, a_loc, b_loc, c_loc) WHERE a.imp = 'A' AND b.imp = 'N' AND c.imp = 'R'""")
def jn3_three_way(spark, sf):
    g = log(spark, sf).groupBy(*D, "imp").agg(F.avg("timer").alias("t"))
    one = lambda i, name: g.where(F.col("imp") == i).select(*D, r("t", 11).alias(name))
    return one("A", "t_a").join(one("N", "t_n"), D).join(one("R", "t_r"), D)


@query("jn4_best_of_two", f"""WITH {LOG_SQL}, x AS (SELECT {KEY_SQL}, min(timer) AS tm FROM log WHERE imp = 'A' GROUP BY ALL), y AS (SELECT {KEY_SQL}, min(timer) AS tm FROM log WHERE imp = 'R' GROUP BY ALL)
SELECT {", ".join(f"coalesce(x.{k}, y.{k}) AS {k}" for k in KEYS)}, x.tm AS t_x, y.tm AS t_y, least(x.tm, y.tm) AS best FROM x FULL JOIN y ON {" AND ".join(f"x.{k} = y.{k}" for k in KEYS)}""")
def jn4_best_of_two(spark, sf):
    """Full outer: a descriptor that one side lacks keeps the other's time."""
    df = log(spark, sf)
    x = df.where("imp = 'A'").groupBy(*KEYS).agg(F.min("timer").alias("t_x"))
    y = df.where("imp = 'R'").groupBy(*KEYS).agg(F.min("timer").alias("t_y"))
    return x.join(y, KEYS, "full").select(*KEYS, "t_x", "t_y", F.least("t_x", "t_y").alias("best"))


@query("jn5_ratio_to_baseline", f"""WITH {GROUP_SQL}, perf AS (SELECT *, M * N * (2 * K + 2) / (1e9 * timer) AS p FROM grp), base AS (SELECT M, N, K, a_loc, b_loc, c_loc, arg_max(p, (T, dev_num)) AS b FROM perf WHERE imp = 'A' AND T > 512 GROUP BY ALL)
SELECT {KEY_SQL}, imp, round(coalesce(p / b, 1), 6) + 0.0 AS ratio FROM perf LEFT JOIN base USING (M, N, K, a_loc, b_loc, c_loc)""")
def jn5_ratio_to_baseline(spark, sf):
    """Rate over that of the baseline's last variant; 1 where there is none."""
    p = grouped(spark, sf).withColumn("p", mt.gflops(mt.flops_run(F.col("M"), F.col("N"), F.col("K")), F.col("timer")))
    base = p.where("imp = 'A' AND T > 512").groupBy(*D).agg(F.max_by("p", F.struct("T", "dev_num")).alias("b"))
    return p.join(base, D, "left").select(*KEYS, "imp", r(F.coalesce(F.try_divide(F.col("p"), F.col("b")), F.lit(1.0))).alias("ratio"))


@query("set1_concat", f"WITH {LOG_SQL}, x AS (SELECT 'mine' AS imp, T, timer, pred_t FROM log WHERE imp = 'A'), y AS (SELECT 'other' AS imp, T, timer FROM log WHERE imp <> 'A'), u AS (SELECT * FROM x UNION ALL BY NAME SELECT * FROM y) SELECT imp, T, count(*) AS n, count(pred_t) AS n_pred, round(sum(timer), 4) + 0.0 AS t FROM u GROUP BY ALL")
def set1_concat(spark, sf):
    """A bag union of implementations with different columns. The SQL's columns ``T`` and ``t`` differ by case only."""
    df = log(case_sensitive(spark), sf)
    x = df.where("imp = 'A'").select(F.lit("mine").alias("imp"), "T", "timer", "pred_t")
    y = df.where("imp <> 'A'").select(F.lit("other").alias("imp"), "T", "timer")
    return x.unionByName(y, allowMissingColumns=True).groupBy("imp", "T").agg(F.count("*").alias("n"), F.count("pred_t").alias("n_pred"), r(F.sum("timer"), 4).alias("t"))


@query("ord3_series", f"WITH {GROUP_SQL} SELECT imp, M, N, K, T, dev_num, a_loc, b_loc, c_loc, row_number() OVER (PARTITION BY imp ORDER BY M * N * K, T, dev_num, M, a_loc, b_loc, c_loc)::INT AS place FROM grp")
def ord3_series(spark, sf):
    """Each implementation's series in order of problem size; a series isn't sorted in one task."""
    order = [F.col("M") * F.col("N") * F.col("K"), *map(F.col, ("T", "dev_num", "M", *LOCS))]
    return od.ranked(grouped(spark, sf), ["imp"], order, "place").select("imp", "M", "N", "K", "T", "dev_num", *LOCS, F.col("place").cast("int").alias("place"))
