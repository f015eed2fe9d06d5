"""Queries of the blocked linear algebra operators over whole tables.

The matrix E is ``embeddings`` (a row for each vector), P the mean vector of each label,
S the 64 x 64 moment matrix E^T E scaled by 1 / 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import exact as ex
from tilewright.operators import linalg as la
from tilewright.queries.registry import query, r, sql_values, table, values

ALPHA, BETA = 1.2345, 1.1154
E_SQL = "e AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
P_SQL = "p AS (SELECT label::BIGINT AS i, j, avg(v) AS v FROM e JOIN embeddings ON vec_id = i GROUP BY label, j)"
S_SQL = "s AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / 100 AS v FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j)"


def e(spark, sf):
    return la.cells(table(spark, sf, "embeddings"), "vec_id", "embedding")


def p(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"))
    return e(spark, sf).join(labels, "i").groupBy(F.col("label").alias("i"), "j").agg(F.avg("v").alias("v"))


def e_rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("row"))


def s(spark, sf):
    return la.gemm_tall(e_rows(spark, sf), alpha=0.01)


def out(df, *keys):
    return df.select(*keys, r("v").alias("v"))


@query("la1_dgemm_nn", f"WITH {E_SQL}, {S_SQL} SELECT e.i, s.j, round({ALPHA} * sum(e.v * s.v) + {BETA} * any_value(c.v), 6) + 0.0 AS v FROM e JOIN s ON e.j = s.i JOIN e c ON c.i = e.i AND c.j = s.j GROUP BY e.i, s.j")
def la1_dgemm_nn(spark, sf):
    """C(n x 64) <- alpha E S + beta E, S sent to every task as an array."""
    return out(la.gemm_small(e_rows(spark, sf), s(spark, sf), e(spark, sf), ALPHA, BETA), "i", "j")


@query("la1_dgemm_tn", f"WITH {E_SQL}, {S_SQL}, q AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j) SELECT q.i, q.j, round({ALPHA} * q.v + {BETA} * s.v, 6) + 0.0 AS v FROM q JOIN s ON q.i = s.i AND q.j = s.j")
def la1_dgemm_tn(spark, sf):
    """C(64 x 64) <- alpha E^T E + beta S: the long dimension is the inner one, one dense product a task."""
    return out(la.gemm_tall(e_rows(spark, sf), None, s(spark, sf), ALPHA, BETA), "i", "j")


@query("la1_dgemm_nt", f"WITH {E_SQL}, {P_SQL} SELECT e.i, p.i AS j, round({ALPHA} * sum(e.v * p.v), 6) + 0.0 AS v FROM e JOIN p ON e.j = p.j GROUP BY e.i, p.i")
def la1_dgemm_nt(spark, sf):
    """C(n x labels) <- alpha E P^T, beta 0: C isn't read."""
    return out(la.gemm(e(spark, sf), p(spark, sf), None, ALPHA, 0.0, "N", "T"), "i", "j")


@query("la1_dgemm_tt", f"WITH {E_SQL}, {S_SQL} SELECT s.j AS i, e.i AS j, round(sum(s.v * e.v), 6) + 0.0 AS v FROM s JOIN e ON s.i = e.j GROUP BY s.j, e.i")
def la1_dgemm_tt(spark, sf):
    """C(64 x n) <- S^T E^T, made as E S row by row: transposing swaps the index columns."""
    return out(la.transposed(la.gemm_small(e_rows(spark, sf), s(spark, sf))), "i", "j")


@query("la2_sgemm", f"WITH {E_SQL}, {P_SQL} SELECT e.i, p.i AS j, round(sum(e.v * p.v::FLOAT::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 AS v FROM e JOIN p ON e.j = p.j GROUP BY e.i, p.i")
def la2_sgemm(spark, sf):
    """Operands as float, summed in double, rounded to float at the end."""
    c = la.gemm(e(spark, sf), p(spark, sf), trans_b="T", single=True)
    return c.select("i", "j", r(F.col("v").cast("double"), 4).alias("v"))


@query("la3_dgemv_n", f"WITH {E_SQL}, x AS (SELECT j AS i, avg(v) AS v FROM e GROUP BY j), y AS (SELECT vec_id AS i, label::DOUBLE AS v FROM embeddings) SELECT e.i, round({ALPHA} * sum(e.v * x.v) + {BETA} * any_value(y.v), 6) + 0.0 AS v FROM e JOIN x ON e.j = x.i JOIN y ON y.i = e.i GROUP BY e.i")
def la3_dgemv_n(spark, sf):
    """y <- alpha E x + beta y; x: the column means, y: the labels."""
    m = e(spark, sf)
    x = m.groupBy(F.col("j").alias("i")).agg(F.avg("v").alias("v"))
    y = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("v"))
    return out(la.gemv(m, x, y, ALPHA, BETA), "i")


@query("la3_dgemv_t", f"WITH {E_SQL} SELECT j AS i, round({ALPHA} * sum(v * label), 6) + 0.0 AS v FROM e JOIN embeddings ON vec_id = i GROUP BY j")
def la3_dgemv_t(spark, sf):
    y = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("v"))
    return out(la.gemv(e(spark, sf), y, alpha=ALPHA, trans="T"), "i")


def order_vectors(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    y = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("i")).agg(F.sum("l_quantity").alias("v"))
    return x, y


VEC_SQL = "x AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders), y AS (SELECT l_orderkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1)"


@query("la4_daxpy", f"WITH {VEC_SQL} SELECT coalesce(x.i, y.i) AS i, round({ALPHA} * coalesce(x.v, 0) + coalesce(y.v, 0), 7) + 0.0 AS v FROM y FULL JOIN x ON x.i = y.i")
def la4_daxpy(spark, sf):
    x, y = order_vectors(spark, sf)
    return la.axpy(x, y, ALPHA).select("i", r("v", 7).alias("v"))


@query("la5_ddot", f"WITH {VEC_SQL} SELECT round((7.5 + sum(x.v * y.v)) / 1e6, 4) + 0.0 AS v FROM x JOIN y ON x.i = y.i")
def la5_ddot(spark, sf):
    """The product is added to the caller's value."""
    x, y = order_vectors(spark, sf)
    return la.dot(x, y, 7.5).select(r(F.col("v") / 1e6, 4).alias("v"))


@query("la5_ddot_exact", "WITH t AS (SELECT o_custkey % 7 AS k, round(o_totalprice * 100)::BIGINT::HUGEINT * (o_orderkey * 7919 + 13)::HUGEINT AS p FROM orders) SELECT k, sum(p)::DOUBLE AS v FROM t GROUP BY k")
def la5_ddot_exact(spark, sf):
    """Inner products by customer group of cents and keys, beyond a double's digits: the exact sum, rounded once, in any partitioning."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("k"), F.round(F.col("o_totalprice") * 100).alias("v"), (F.col("o_orderkey") * 7919 + 13).cast("double").alias("w"))
    return ex.exact_sum(rows, ["k"], "v", "w")


@query("la6_controlled_gemm", f"WITH {E_SQL}, {P_SQL} SELECT p.i, e.i AS j, round(sum(e.v * p.v), 6) + 0.0 AS v FROM e JOIN p ON e.j = p.j GROUP BY e.i, p.i")
def la6_controlled_gemm(spark, sf):
    """A caller-fixed plan (tiles of 32) leaves the value as it is."""
    return out(la.gemm(p(spark, sf), e(spark, sf), trans_b="T", plan=PLAN), "i", "j")


PLAN = {"T": 32, "units": [0, 1]}


@query("la6_controlled_vectors", f"WITH {VEC_SQL} SELECT 'axpy' AS routine, count(*) AS n, round(sum({ALPHA} * coalesce(x.v, 0) + coalesce(y.v, 0)) / 1e6, 5) + 0.0 AS v FROM y FULL JOIN x ON x.i = y.i UNION ALL SELECT 'dot', 1, round((7.5 + sum(x.v * y.v)) / 1e6, 4) + 0.0 FROM x JOIN y ON x.i = y.i")
def la6_controlled_vectors(spark, sf):
    """axpy and dot under a caller's plan."""
    x, y = order_vectors(spark, sf)
    z = la.axpy(x, y, ALPHA, plan=PLAN).agg(F.lit("axpy").alias("routine"), F.count("*").alias("n"), r(F.sum("v") / 1e6, 5).alias("v"))
    return z.unionByName(la.dot(x, y, 7.5, plan=PLAN).select(F.lit("dot").alias("routine"), F.lit(1).cast("long").alias("n"), r(F.col("v") / 1e6, 4).alias("v")))


@query("la6_controlled_sgemm_gemv", f"WITH {E_SQL}, {P_SQL}, x AS (SELECT j AS i, avg(v) AS v FROM e GROUP BY j) SELECT 'gemv' AS routine, e.i, 0 AS j, round({ALPHA} * sum(e.v * x.v), 6) + 0.0 AS v FROM e JOIN x ON e.j = x.i GROUP BY e.i UNION ALL SELECT 'sgemm', p.i, e.i, round(sum(e.v * p.v::FLOAT::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 FROM e JOIN p ON e.j = p.j GROUP BY e.i, p.i")
def la6_controlled_sgemm_gemv(spark, sf):
    """gemv and sgemm under a caller's plan."""
    m = e(spark, sf)
    x = m.groupBy(F.col("j").alias("i")).agg(F.avg("v").alias("v"))
    y = la.gemv(m, x, alpha=ALPHA, plan=PLAN).select(F.lit("gemv").alias("routine"), "i", F.lit(0).cast("long").alias("j"), r("v").alias("v"))
    c = la.gemm(p(spark, sf), m, trans_b="T", single=True, plan=PLAN)
    return y.unionByName(c.select(F.lit("sgemm").alias("routine"), "i", "j", r(F.col("v").cast("double"), 4).alias("v")))


@query("la8_leading_dimension", "WITH f AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders) SELECT i % 8 AS i, i // 8 AS j, v FROM f WHERE i % 8 < 6")
def la8_leading_dimension(spark, sf):
    """Orders as a flat column-major matrix: 6 rows of leading dimension 8."""
    flat = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return la.from_flat(flat, 6, 8)


@query("la8_strided_axpy", "WITH x AS (SELECT o_orderkey // 2 AS i, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), y AS (SELECT o_orderkey // 3 AS i, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0) SELECT i, round(0.5 * coalesce(x.v, 0) + coalesce(y.v, 0), 4) + 0.0 AS v FROM y FULL JOIN x USING (i)")
def la8_strided_axpy(spark, sf):
    """x at stride 2 and y at stride 3 of one flat vector: the stride is the operator's argument."""
    flat = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return la.axpy(la.strided(flat, 2), la.strided(flat, 3), 0.5).select("i", r("v", 4).alias("v"))


@query("la9_blocked_gemm", f"WITH {E_SQL} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j")
def la9_blocked_gemm(spark, sf):
    """E^T E by tiles of 48, a size that divides neither dimension."""
    m = e(spark, sf)
    return out(la.gemm_blocked(m, m, 48, trans_a="T"), "i", "j")


PROBLEMS = [(k, m, n, kk, t, cap) for k, (m, n, kk, t, cap) in enumerate([(64, 64, 64, 16, 1 << 16), (100, 40, 70, 32, 1 << 15), (17, 19, 23, 8, 1 << 12), (9, 200, 33, 16, 1 << 11), (512, 512, 16, 256, 1 << 24)])]
PROBLEM_SQL = sql_values(PROBLEMS, "p", "pid, M, N, K, T, cap")


def problems(spark):
    return values(spark, PROBLEMS, "pid int, M long, N long, K long, T long, cap long")


@query("la10_task_grid", f"""WITH {PROBLEM_SQL}, g AS (SELECT *, ceil(M / T)::BIGINT AS gm, ceil(N / T)::BIGINT AS gn, ceil(K / T)::BIGINT AS gk FROM p)
SELECT pid::INT AS pid, (mi * gn + ni) * gk + ki AS sk, mi, ni, ki FROM g, range(100) a(mi), range(100) b(ni), range(100) c(ki) WHERE mi < gm AND ni < gn AND ki < gk""")
def la10_task_grid(spark, sf):
    return la.task_grid(problems(spark))


for _name, _mode in (("la11_reduce_wr", "WR"), ("la12_reduce_lazy", "WR_LAZY"), ("la13_reduce_at_output", "W_REDUCE")):
    @query(_name, f"WITH {E_SQL}, {S_SQL}, t AS (SELECT a.j AS i, b.j, a.i // 64 AS ki, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL), q AS (SELECT i, j, sum(v) AS v FROM t GROUP BY i, j) SELECT q.i, q.j, round({ALPHA} * q.v + {BETA} * s.v, 6) + 0.0 AS v FROM q JOIN s ON q.i = s.i AND q.j = s.j")
    def k_reduction(spark, sf, mode=_mode):
        """Partial tiles of 64 along the inner dimension, their sum, and beta C once: by the mode's way."""
        m = e(spark, sf)
        return out(la.gemm(m, m, s(spark, sf), ALPHA, BETA, "T", "N", plan={"T": 64}, mode=mode), "i", "j")


SHAPE_SQL = """sh AS (SELECT p_partkey AS pid, CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'T' END AS ta, CASE p_partkey % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'T' WHEN 2 THEN 'T' WHEN 3 THEN 'T' ELSE 'N' END AS tb,
(p_size % 3) + 4 AS ar, (p_size % 4) + 3 AS ac, (p_size % 4) + 3 AS br, (p_partkey % 3) + 4 AS bc, (p_size % 3) + 4 AS cr, (p_partkey % 3) + 4 AS cc FROM part)"""


@query("la14_conformance", f"""WITH {SHAPE_SQL}, op AS (SELECT pid, ta, tb, CASE ta WHEN 'N' THEN ar ELSE ac END AS m, CASE ta WHEN 'N' THEN ac ELSE ar END AS ka, CASE tb WHEN 'N' THEN br ELSE bc END AS kb, CASE tb WHEN 'N' THEN bc ELSE br END AS n, cr, cc FROM sh)
SELECT pid, ta, tb, tb IN ('N', 'T') AND ka = kb AND m = cr AND n = cc AS fits FROM op""")
def la14_conformance(spark, sf):
    """Shapes and flags of every part's operands, most of which don't go together."""
    size, key = F.col("p_size"), F.col("p_partkey")
    sh = table(spark, sf, "part").select(
        key.alias("pid"), F.when(size % 2 == 0, "N").otherwise("T").alias("ta"), F.when(key % 7 == 0, "C").when((key % 7).isin(1, 2, 3), "T").otherwise("N").alias("tb"),
        (size % 3 + 4).alias("ar"), (size % 4 + 3).alias("ac"), (size % 4 + 3).alias("br"), (key % 3 + 4).alias("bc"), (size % 3 + 4).alias("cr"), (key % 3 + 4).alias("cc"))
    return sh.select("pid", "ta", "tb", la.fits(*map(F.col, ("ta", "ar", "ac", "tb", "br", "bc", "cr", "cc"))).alias("fits"))


@query("la16_plan_reuse", "WITH c AS (SELECT p_partkey AS pid, p_brand AS func, p_size % 5 AS M, p_partkey % 3 AS loc FROM part), f AS (SELECT func, M, loc, min(pid) AS planned_by FROM c GROUP BY ALL) SELECT pid, planned_by, pid <> planned_by AS reuses FROM c JOIN f USING (func, M, loc)")
def la16_plan_reuse(spark, sf):
    """Which earlier call's plan each call takes: equal routine, size and operand location."""
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("func"), (F.col("p_size") % 5).alias("M"), (F.col("p_partkey") % 3).alias("loc"))
    return la.plan_reuse(c, "pid", ["func", "M", "loc"]).select("pid", "planned_by", "reuses")


@query("la15_buffer_blocks", f"""WITH {PROBLEM_SQL}, g AS (SELECT *, ceil(M / T)::BIGINT AS gm, ceil(N / T)::BIGINT AS gn, ceil(K / T)::BIGINT AS gk FROM p),
h AS (SELECT pid, gm * gk + gk * gn + 2 * gm * gn AS needed, cap // (8 * T * T) AS room FROM g)
SELECT pid::INT AS pid, needed, least(needed, room)::BIGINT AS held, least(needed, room) >= 3 AS fits FROM h""")
def la15_buffer_blocks(spark, sf):
    return la.buffer_blocks(problems(spark))


@query("la17_dsyrk", f"WITH {E_SQL} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b ON a.i = b.i WHERE a.j <= b.j GROUP BY a.j, b.j")
def la17_dsyrk(spark, sf):
    return out(la.syrk_tall(e_rows(spark, sf)), "i", "j")


@query("la18_sdot", f"WITH {VEC_SQL} SELECT round((7.5 + sum(x.v::FLOAT::DOUBLE * y.v::FLOAT::DOUBLE))::FLOAT::DOUBLE / 1e6, 2) + 0.0 AS v FROM x JOIN y ON x.i = y.i")
def la18_sdot(spark, sf):
    x, y = order_vectors(spark, sf)
    return la.dot(x, y, 7.5, single=True).select(r(F.col("v").cast("double") / 1e6, 2).alias("v"))


@query("la18_sgemv", f"WITH {E_SQL}, x AS (SELECT j AS i, avg(v)::FLOAT::DOUBLE AS v FROM e GROUP BY j) SELECT e.i, round((1.5 * sum(e.v * x.v))::FLOAT::DOUBLE, 4) + 0.0 AS v FROM e JOIN x ON e.j = x.i GROUP BY e.i")
def la18_sgemv(spark, sf):
    m = e(spark, sf)
    x = m.groupBy(F.col("j").alias("i")).agg(F.avg("v").alias("v"))
    return la.gemv(m, x, alpha=1.5, single=True).select("i", r(F.col("v").cast("double"), 4).alias("v"))


@query("la18_single_precision", "SELECT o_orderkey AS i, (1.5::DOUBLE * o_totalprice::FLOAT::DOUBLE + o_orderkey::FLOAT::DOUBLE)::FLOAT::DOUBLE AS v FROM orders")
def la18_single_precision(spark, sf):
    """saxpy."""
    o = table(spark, sf, "orders")
    x = o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    y = o.select(F.col("o_orderkey").alias("i"), F.col("o_orderkey").cast("double").alias("v"))
    return la.axpy(x, y, 1.5, single=True).select("i", F.col("v").cast("double").alias("v"))
