"""Logs written from whole tables, read back and modelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.queries.registry import query, r, table
from tilewright.queries.run_log import LOG_SQL, log
from tilewright.queries.transfers import TRACE_SQL, trace
from tilewright.sources import logs, sinks
from tilewright.sources.paths import scratch

FULL_SQL = f"""{LOG_SQL}, run AS (SELECT T, dev_num, (10 ** (dev_num - 1))::BIGINT AS dev_id_token, seq AS cachesize_limit, CASE WHEN M > 4096 THEN 'T' ELSE 'N' END AS trans_a, 'N' AS trans_b,
1.5::DOUBLE AS alpha, 0.5::DOUBLE AS beta, M, N, K, a_loc, b_loc, c_loc, c_loc AS c_out_loc, timer, pred_t, round(pred_J, 3) + 0.0 AS pred_J FROM log)"""


def full_log(spark, sf):
    return log(spark, sf).select(
        "T", "dev_num", F.pow(F.lit(10.0), F.col("dev_num") - 1).cast("long").alias("dev_id_token"), F.col("seq").alias("cachesize_limit"), F.when(F.col("M") > 4096, "T").otherwise("N").alias("trans_a"), F.lit("N").alias("trans_b"),
        F.lit(1.5).alias("alpha"), F.lit(0.5).alias("beta"), "M", "N", "K", "a_loc", "b_loc", "c_loc", F.col("c_loc").alias("c_out_loc"), "timer", "pred_t", r("pred_J", 3).alias("pred_J"))


@query("src10_run_log", f"WITH {FULL_SQL} SELECT * REPLACE (round(pred_t, 6) + 0.0 AS pred_t) FROM run")
def src10_run_log(spark, sf):
    """The 18-column run log, written and read by its schema."""
    path = scratch(spark, "runlog")
    sinks.append_run_log(full_log(spark, sf), path)
    return logs.read(spark, path, "run18").drop("file").withColumn("pred_t", r("pred_t"))


@query("src9_run_log_16", f"WITH {FULL_SQL} SELECT * EXCLUDE (pred_t, pred_J) FROM run")
def src9_run_log_16(spark, sf):
    path = scratch(spark, "runlog16")
    sinks.append_run_log(full_log(spark, sf), path, "run16")
    return logs.read(spark, path, "run16").drop("file")


@query("src11_validation_columns", f"WITH {FULL_SQL} SELECT T, dev_num, dev_id_token, trans_a, trans_b, M, N, K, a_loc, b_loc, c_loc, c_out_loc, timer, round(pred_t, 6) + 0.0 AS pred_t, pred_J FROM run")
def src11_validation_columns(spark, sf):
    path = scratch(spark, "validation")
    sinks.append_run_log(full_log(spark, sf), path)
    return logs.read(spark, path, "run18", "validation").withColumn("pred_t", r("pred_t"))


@query("src13_trace", f"WITH {TRACE_SQL} SELECT src, dest, route, bytes::BIGINT AS bytes, fire_t, sced_t, round(complete_t, 9) + 0.0 AS complete_t FROM trace")
def src13_trace(spark, sf):
    """The transfer trace, written as text lines and read back."""
    path = scratch(spark, "trace")
    sinks.trace_lines(trace(spark, sf)).write.text(path)
    return logs.read(spark, path, "trace").drop("file").withColumn("complete_t", r("complete_t", 9))


BENCH_SQL = """b AS (SELECT (p_partkey % 4)::INT - 1 AS dev, CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'T' END AS trans_a, CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE 'T' END AS trans_b,
256 * (1 + p_partkey // 24) AS M, p_size AS w, p_retailprice AS t, p_partkey FROM part)"""


def bench(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(
        ((c("p_partkey") % 4).cast("int") - 1).alias("dev"), F.when(c("p_partkey") % 2 == 0, "N").otherwise("T").alias("trans_a"), F.when(c("p_partkey") % 3 == 0, "N").otherwise("T").alias("trans_b"),
        (256 * (1 + F.expr("p_partkey div 24"))).alias("M"), c("p_retailprice").alias("mean_t"), c("p_size").cast("double").alias("w_avg"))


@query("src6_benchmark_glob", f"WITH {BENCH_SQL} SELECT 'Dgemm' AS func, dev, trans_a, trans_b, M, M AS N, M AS K, t AS mean_t, w::DOUBLE AS w_avg FROM b")
def src6_benchmark_glob(spark, sf):
    """Benchmark logs by device and flags, in folders that tell them; read at once, the flags from the names."""
    path = scratch(spark, "bench")
    c = F.col
    name = F.format_string("cublasDgemm_dev-%d_TransA-%s_TransB-%s_1.1.log", "dev", "trans_a", "trans_b")
    rows = bench(spark, sf).select(name.alias("log"), "M", c("M").alias("N"), c("M").alias("K"), "mean_t", "w_avg", F.lit(-1.0).alias("joules"), F.lit(0.01).alias("margin_err"), F.lit(11).alias("samples"), F.lit(1.5).alias("bench_t"))
    rows.write.partitionBy("log").csv(path)
    return logs.read_benchmarks(spark, path).select("func", "dev", "trans_a", "trans_b", "M", "N", "K", "mean_t", "w_avg")


@query("snk1_lookup_table", f"WITH {BENCH_SQL}, g AS (SELECT trans_a, trans_b, M AS T, avg(t) AS mean_t, avg(w) AS w_avg FROM b WHERE dev = 0 GROUP BY ALL) SELECT trans_a, trans_b, T, round(mean_t, 3) + 0.0 AS mean_t, round(w_avg, 4) + 0.0 AS w_avg FROM g")
def snk1_lookup_table(spark, sf):
    """A device's lookup table, written in order of size and read by the loader's schema."""
    path = scratch(spark, "lookup")
    g = bench(spark, sf).where("dev = 0").groupBy("trans_a", "trans_b", "M").agg(F.avg("mean_t").alias("mean_t"), F.avg("w_avg").alias("w_avg"))
    rows = g.select("trans_a", "trans_b", "M", F.col("M").alias("N"), F.col("M").alias("K"), "mean_t", "w_avg", F.lit(-1.0).alias("joules"), F.lit(0.01).alias("margin_err"), F.lit(11).cast("long").alias("samples"), F.lit(1.5).alias("bench_t"))
    sinks.write_lookup(rows, path)
    return logs.read(spark, path, "lookup_l3", "lookup_l3").select("trans_a", "trans_b", "T", r("mean_t", 3).alias("mean_t"), r("w_avg", 4).alias("w_avg"))


@query("snk2_link_models", f"""WITH {TRACE_SQL}, l AS (SELECT dest, src, format('{{:e}}', abs(regr_intercept(transfer_t, fire_t)))::DOUBLE AS ti FROM m GROUP BY ALL),
raw AS (SELECT dest, src, (routed)::INT AS osrc, 0 AS odest, avg(pipe_t) / 0.126 AS sl FROM m GROUP BY ALL)
SELECT l.dest, l.src, round(ti * 1e6, 2) + 0.0 AS ti_us, osrc, odest, round(CASE WHEN sl < 0.95 THEN 1 WHEN sl > 2 THEN 2 WHEN abs(sl - 1) <= 0.05 THEN 1 ELSE sl END, 4) + 0.0 AS sl FROM l JOIN raw USING (dest, src)""")
def snk2_link_models(spark, sf):
    """Fitted links and slowdowns written as model texts, read back and brought into range."""
    from tilewright.operators.traces import transfer_metrics

    m = transfer_metrics(trace(spark, sf))
    fits = m.groupBy("dest", "src").agg(F.regr_slope("transfer_t", "fire_t").alias("tb"), F.abs(F.regr_intercept("transfer_t", "fire_t")).alias("ti"))
    slow = m.groupBy("dest", "src", F.col("routed").cast("int").alias("osrc"), F.lit(0).alias("odest")).agg((F.avg("pipe_t") / 0.126).alias("sl"))
    path = scratch(spark, "links")
    sinks.write_link_models(fits, slow, path)
    models, slowdowns = logs.read_link_models(spark, path)
    return models.join(slowdowns, ["dest", "src"]).select("dest", "src", r(F.col("ti") * 1e6, 2).alias("ti_us"), "osrc", "odest", r("sl", 4).alias("sl"))


@query("snk4_run_log_level2", f"WITH {FULL_SQL} SELECT T, dev_num, dev_id_token, cachesize_limit, trans_a, alpha, beta, M, N, 1::BIGINT AS inc1, 2::BIGINT AS inc2, a_loc, b_loc AS x_loc, c_loc AS y_loc, c_out_loc AS y_out_loc, timer, round(pred_t, 6) + 0.0 AS pred_t, pred_J FROM run")
def snk4_run_log_level2(spark, sf):
    """The level 2 log in its own columns."""
    path, c = scratch(spark, "runlog2"), F.col
    runs = full_log(spark, sf).select("T", "dev_num", "dev_id_token", "cachesize_limit", "trans_a", "alpha", "beta", "M", "N", F.lit(1).alias("inc1"), F.lit(2).alias("inc2"), "a_loc", c("b_loc").alias("x_loc"), c("c_loc").alias("y_loc"), c("c_out_loc").alias("y_out_loc"), "timer", "pred_t", "pred_J")
    sinks.append_run_log(runs, path, "run_l2")
    return logs.read(spark, path, "run_l2").drop("file").withColumn("pred_t", r("pred_t"))


@query("snk5_run_log_level1", f"WITH {FULL_SQL} SELECT T, dev_num, dev_id_token, cachesize_limit, alpha, N, 1::BIGINT AS inc1, 2::BIGINT AS inc2, a_loc AS x_loc, b_loc AS y_loc, a_loc AS x_out_loc, c_out_loc AS y_out_loc, timer FROM run")
def snk5_run_log_level1(spark, sf):
    """The level 1 log, each row a whole line that ends with its time."""
    path, c = scratch(spark, "runlog1"), F.col
    runs = full_log(spark, sf).select("T", "dev_num", "dev_id_token", "cachesize_limit", "alpha", "N", F.lit(1).alias("inc1"), F.lit(2).alias("inc2"), c("a_loc").alias("x_loc"), c("b_loc").alias("y_loc"), c("a_loc").alias("x_out_loc"), c("c_out_loc").alias("y_out_loc"), "timer")
    sinks.append_run_log(runs, path, "run_l1")
    return logs.read(spark, path, "run_l1").drop("file")


@query("snk7_benchmark_rows", f"""WITH {BENCH_SQL} SELECT 3 AS level, dev, trans_a, trans_b, count(*) AS n, sum(M)::BIGINT AS size, round(sum(format('{{:e}}', t)::DOUBLE), 4) + 0.0 AS t FROM b GROUP BY ALL
UNION ALL SELECT 2, dev, trans_a, NULL, count(*), sum(M)::BIGINT, round(sum(format('{{:e}}', t)::DOUBLE), 4) + 0.0 FROM b GROUP BY ALL UNION ALL SELECT 1, dev, NULL, NULL, count(*), sum(M)::BIGINT, round(sum(format('{{:e}}', t)::DOUBLE), 4) + 0.0 FROM b GROUP BY ALL
UNION ALL SELECT 0, dev, NULL, NULL, count(*), sum(M)::BIGINT * 64, round(sum(format('{{:e}}', t)::DOUBLE), 4) + 0.0 FROM b GROUP BY ALL""")
def snk7_benchmark_rows(spark, sf):
    """Benchmark rows of the three levels and of links, written by one writer and read back by their names."""
    c = F.col
    df = bench(spark, sf).select("dev", "trans_a", "trans_b", "M", c("M").alias("N"), c("M").alias("K"), "mean_t", "w_avg", F.lit(-1.0).alias("joules"), F.lit(0.01).alias("margin_err"), F.lit(11).alias("samples"), F.lit(1.5).alias("bench_t"))
    none, parts = F.lit(None).cast("string"), []
    for level, func in ((3, "Dgemm"), (2, "Dgemv"), (1, "Daxpy")):
        path = scratch(spark, f"bench{level}")
        sinks.write_benchmarks(df.withColumn("func", F.lit(func)), path, level)
        back = logs.read_benchmarks(spark, path, level)
        flags = [c(f) if f in back.columns else none.alias(f) for f in ("trans_a", "trans_b")]
        parts.append(back.select(F.lit(level).alias("level"), "dev", *flags, c("M" if level > 1 else "N").alias("size"), "mean_t"))
    path = scratch(spark, "benchlinks")
    sinks.write_benchmarks(df.select(c("dev").alias("dest"), F.lit(-1).alias("src"), F.lit(8).alias("dim1"), c("M").cast("int").alias("dim2"), c("mean_t").alias("transfer_t"), F.lit(0.01).alias("error"), F.lit(5).alias("reps"), F.lit(1.0).alias("benchmark_t")), path, None)
    parts.append(logs.read_links(spark, path).select(F.lit(0).alias("level"), c("dest").alias("dev"), none.alias("trans_a"), none.alias("trans_b"), c("bytes").alias("size"), c("transfer_t").alias("mean_t")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("level", "dev", "trans_a", "trans_b").agg(F.count("*").alias("n"), F.sum("size").alias("size"), r(F.sum("mean_t"), 4).alias("t"))


@query("snk6_idempotent_append", f"WITH {FULL_SQL} SELECT T, dev_num, count(DISTINCT (cachesize_limit, trans_a, M, N, K, a_loc, b_loc, c_loc)) AS rows_ FROM run GROUP BY ALL")
def snk6_idempotent_append(spark, sf):
    """Appending the same runs twice leaves one row for each key."""
    path = scratch(spark, "append")
    runs = full_log(spark, sf)
    sinks.append_new(runs.where("T <= 1024"), path)
    sinks.append_new(runs, path)
    return logs.read(spark, path, "run18").groupBy("T", "dev_num").agg(F.count("*").alias("rows_"))


@query("snk9_plan_token", "SELECT event_id, (256 * (1 + user_id % 8)) || ',' || (1 + event_id % 3) || ',' || CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 111 END || ',' || (user_id * 64) AS token FROM events")
def snk9_plan_token(spark, sf):
    units = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", sinks.plan_token(256 * (1 + F.col("user_id") % 8), units, F.col("user_id") * 64).alias("token"))


@query("src15_hashed_init", """WITH x AS (SELECT o_orderkey AS i, ((o_orderkey % 2147483647) * 48271 + 42 * 69621) % 2147483647 AS x FROM orders), y AS (SELECT i, (x * 48271 + 11) % 2147483647 AS x FROM x)
SELECT i, (x * 16807 % 2147483647) / 2147483647.0::DOUBLE AS v FROM y""")
def src15_hashed_init(spark, sf):
    """A deterministic uniform number for each order."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), logs.hashed_uniform(F.col("o_orderkey"), 42).alias("v"))
