"""gemm and its kin against NumPy: square, non-square and awkward sizes, all flags, three betas."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tilewright.operators import linalg as la

ALPHA = 1.23


def table(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")


def vector(spark, v):
    return spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(v)], "i long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("shape", [(16, 16, 16), (17, 19, 23), (40, 8, 12)])
@pytest.mark.parametrize("flags", ["NN", "NT", "TN", "TT"])
def test_gemm(spark, shape, flags):
    m, n, k = shape
    rng = np.random.default_rng(42)
    a, b, c = rng.random((m, k)), rng.random((k, n)), rng.random((m, n))
    ta, tb = table(spark, a if flags[0] == "N" else a.T), table(spark, b if flags[1] == "N" else b.T)
    for beta in (0.0, 0.9876):
        got = dense(la.gemm(ta, tb, table(spark, c), ALPHA, beta, *flags), (m, n))
        assert np.allclose(got, ALPHA * a @ b + beta * c, rtol=1e-9)
    assert np.allclose(dense(la.gemm_blocked(ta, tb, 7, table(spark, c), ALPHA, 1.0, *flags), (m, n)), ALPHA * a @ b + c, rtol=1e-9)


def test_beta_zero_does_not_read_c(spark):
    a = np.eye(3)
    c = spark.createDataFrame([(0, 0, float("nan")), (1, 1, None)], "i long, j long, v double")
    assert np.allclose(dense(la.gemm(table(spark, a), table(spark, a), c, 2.0, 0.0), (3, 3)), 2 * a)


def test_missing_cells_are_zero(spark):
    a, c = spark.createDataFrame([(0, 0, 2.0)], "i long, j long, v double"), spark.createDataFrame([(1, 1, 5.0)], "i long, j long, v double")
    assert np.allclose(dense(la.gemm(a, a, c, 1.0, 2.0), (2, 2)), [[4, 0], [0, 10]])


def test_small_form_and_block_sizes_agree(spark):
    rng = np.random.default_rng(43)
    a, b = rng.random((30, 12)), rng.random((12, 5))
    rows = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(a)], "i long, row array<double>")
    assert np.allclose(dense(la.gemm_small(rows, table(spark, b), alpha=ALPHA), (30, 5)), ALPHA * a @ b, rtol=1e-9)
    for size in (1, 5, 64):
        assert np.allclose(dense(la.gemm_blocked(table(spark, a), table(spark, b), size), (30, 5)), a @ b, rtol=1e-9)


def test_syrk_gemv_axpy_dot(spark):
    rng = np.random.default_rng(44)
    a, x, y = rng.random((17, 19)), rng.random(19), rng.random(17)
    assert np.allclose(dense(la.syrk(table(spark, a)), (17, 17)), np.triu(a @ a.T), rtol=1e-9)
    got = {r.i: r.v for r in la.gemv(table(spark, a), vector(spark, x), vector(spark, y), 2.0, 0.5).collect()}
    assert np.allclose([got[k] for k in range(17)], 2 * a @ x + 0.5 * y, rtol=1e-9)
    got = {r.i: r.v for r in la.gemv(table(spark, a), vector(spark, y), trans="T").collect()}
    assert np.allclose([got[k] for k in range(19)], a.T @ y, rtol=1e-9)
    got = {r.i: r.v for r in la.axpy(vector(spark, x), vector(spark, x[:5]), 3.0).collect()}
    assert np.allclose([got[k] for k in range(5)], 4 * x[:5], rtol=1e-9)
    assert abs(la.dot(vector(spark, x), vector(spark, x), 7.5).first().v - (7.5 + x @ x)) < 1e-9
    assert la.dot(vector(spark, []), vector(spark, x), 1.5).first().v == 1.5
    assert [r.i for r in la.strided(vector(spark, x), 3).orderBy("i").collect()] == list(range(7))


def test_shapes_and_flags_are_checked(spark):
    with pytest.raises(ValueError):
        la.transposed(table(spark, np.eye(2)), "C")
    one = spark.range(1)
    ok = lambda *x: one.select(la.fits(*map(F.lit, x))).first()[0]
    assert ok("N", 3, 4, "N", 4, 6, 3, 6) and ok("T", 4, 3, "T", 6, 4, 3, 6) and ok("T", 4, 3, "N", 4, 6, 3, 6)
    assert not ok("T", 3, 4, "N", 4, 6, 3, 6) and not ok("N", 3, 4, "N", 4, 6, 3, 5) and not ok("C", 4, 3, "N", 4, 6, 3, 6)
    bad = one.select(la.conforming(*map(F.lit, ("N", 3, 4, "T", 4, 6, 3, 6))).alias("x"))
    with pytest.raises(PySparkException):
        bad.collect()


def rows_of(spark, m):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "i long, row array<double>")


@pytest.mark.parametrize("mode", la.MODES)
def test_modes_and_plans_leave_the_value(spark, mode):
    rng = np.random.default_rng(45)
    a, b, c = rng.random((23, 9)), rng.random((23, 5)), rng.random((9, 5))
    want = ALPHA * a.T @ b + 0.9876 * c
    for plan in (None, {"T": 4}):
        got = la.gemm(table(spark, a), table(spark, b), table(spark, c), ALPHA, 0.9876, "T", plan=plan, mode=mode)
        assert np.allclose(dense(got, (9, 5)), want, rtol=1e-9)
    assert np.allclose(dense(la.gemm_tall(rows_of(spark, a), rows_of(spark, b), table(spark, c), ALPHA, 0.9876, mode), (9, 5)), want, rtol=1e-9)
    assert np.allclose(dense(la.gemm_tall(rows_of(spark, a)), (9, 9)), a.T @ a, rtol=1e-9)
    assert np.allclose(dense(la.syrk_tall(rows_of(spark, a), 2.0), (9, 9)), np.triu(2 * a.T @ a), rtol=1e-9)
    with pytest.raises(ValueError):
        la.gemm(table(spark, a), table(spark, b), table(spark, c), 1.0, 1.0, "T", mode="OTHER")


def test_single_precision_and_vector_plans(spark):
    rng = np.random.default_rng(46)
    a, x, y = rng.random((7, 11)), rng.random(11), rng.random(7)
    f = lambda m: m.astype(np.float32).astype(float)
    got = {r.i: r.v for r in la.gemv(table(spark, a), vector(spark, x), vector(spark, y), 0.1, 0.7, single=True).collect()}
    want = (float(np.float32(0.1)) * f(a) @ f(x) + float(np.float32(0.7)) * f(y)).astype(np.float32)
    assert np.allclose([got[k] for k in range(7)], want, rtol=1e-7)
    assert la.dot(vector(spark, x), vector(spark, x), single=True).first().v == pytest.approx(f(x) @ f(x), rel=1e-7)
    assert la.dot(vector(spark, x), vector(spark, x), 1.0, plan={"T": 3}).first().v == pytest.approx(1 + x @ x, rel=1e-12)
    got = {r.i: r.v for r in la.gemv(table(spark, a), vector(spark, x), plan={"T": 4}).collect()}
    assert np.allclose([got[k] for k in range(7)], a @ x, rtol=1e-9)


def test_axpy_takes_the_indices_of_both(spark):
    got = {r.i: r.v for r in la.axpy(vector(spark, [1.0, 2.0, 3.0]), spark.createDataFrame([(2, 5.0), (7, 1.0)], "i long, v double"), 2.0).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: 11.0, 7: 1.0}


def test_ragged_rows_are_refused(spark):
    with pytest.raises(PySparkException):
        la.gemm_tall(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, row array<double>").coalesce(1)).collect()


def test_plan_reuse(spark):
    calls = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "a", None), (4, "b", 1), (5, "b", 2)], "pid int, f string, m int")
    assert {(r.pid, r.planned_by, r.reuses) for r in la.plan_reuse(calls, "pid", ["f", "m"]).collect()} == {(1, 1, False), (2, 2, False), (3, 1, True), (4, 2, True), (5, 5, False)}


def test_task_grid_is_the_nested_loop(spark):
    p = spark.createDataFrame([(1, 9, 5, 7, 4)], "pid int, M long, N long, K long, T long")
    got = [(r.sk, r.mi, r.ni, r.ki) for r in la.task_grid(p).orderBy("sk").collect()]
    assert got == [(k, *x) for k, x in enumerate(itertools.product(range(3), range(2), range(2)))]


def test_plan_cache():
    cache, made = la.PlanCache(2), []
    for d in ("a", "b", "a", "c", "b", "d", "b", "c"):
        cache.get((d,), lambda d=d: made.append(d))
    # the first place goes to c, then to d, then to c again; b keeps its own
    assert made == ["a", "b", "c", "d", "c"]


@pytest.mark.parametrize("family", [[(16, 16, 16), (32, 32, 32), (64, 64, 64)], [(16, 64, 32), (64, 16, 64), (33, 8, 130)], [(17, 23, 19), (68, 4, 76), (23, 92, 19)]])
@pytest.mark.parametrize("box_cells", [1 << 18, 64])
def test_grid_of_any_shape(spark, monkeypatch, family, box_cells):
    """Square, non-square and awkward sizes, each on coarse and on fine grids, and by tiles."""
    monkeypatch.setattr(la, "BOX_CELLS", box_cells)
    rng = np.random.default_rng(47)
    for m, n, k in family:
        a, b = rng.random((m, k)), rng.random((k, n))
        grid = la.grid_of(m, n, k, 8, box_cells)
        assert max(-(-m // grid[0]) * -(-k // grid[2]), -(-n // grid[1]) * -(-k // grid[2]), -(-m // grid[0]) * -(-n // grid[1])) <= box_cells and np.prod(grid) >= 8
        assert np.allclose(dense(la.gemm(table(spark, a), table(spark, b.T), alpha=ALPHA, trans_b="T"), (m, n)), ALPHA * a @ b, rtol=1e-9)
        assert np.allclose(dense(la.gemm(table(spark, a), table(spark, b), plan={"T": 5}), (m, n)), a @ b, rtol=1e-9)


def test_grids_move_little():
    # a short inner dimension isn't what holds the work; a long one is split when rows and columns are few
    assert la.grid_of(10**6, 10, 64, 1000)[1:] == (1, 1)
    assert la.grid_of(64, 64, 10**8, 1000)[:2] == (1, 1) and la.grid_of(64, 64, 10**8, 1000)[2] >= 1000
    p, q, r = la.grid_of(4096, 4096, 4096, 64)
    assert p * q * r >= 64 and p == q


def test_short_inner_dimension_spreads_over_all_tasks(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("false", "-1", "16")):
            spark.conf.set(c, v)
        rng = np.random.default_rng(48)
        a, b = rng.random((128, 2)), rng.random((2, 128))
        product = la.gemm(table(spark, a), table(spark, b), plan={"T": 1})
        rows = product.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(rows) >= 8 and max(r["count"] for r in rows) <= 0.35 * 128 * 128
        assert np.allclose(dense(product, (128, 128)), a @ b)
        # the single-precision routine follows the plan too: its inner dimension is cut at multiples of the tile
        long = la._boxed(table(spark, rng.random((2, 256))), table(spark, rng.random((256, 2))), 32)
        assert long[1] and long[0].groupBy("i", "j").count().where("count BETWEEN 2 AND 8").count() == 4
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_sparse_operands_shifted_indices_and_no_common_index(spark, monkeypatch):
    monkeypatch.setattr(la, "BOX_CELLS", 16)
    rng = np.random.default_rng(49)
    a = {(int(i) + 1000, int(k) + 7): float(v) for i, k, v in zip(rng.integers(0, 40, 90), rng.integers(0, 30, 90), rng.random(90))}
    b = {(int(k) + 3, int(j) + 500): float(v) for k, j, v in zip(rng.integers(0, 30, 90), rng.integers(0, 20, 90), rng.random(90))}
    make = lambda m: spark.createDataFrame([(i, j, v) for (i, j), v in m.items()], "i long, j long, v double")
    want = {}
    for (i, k), x in a.items():
        for (k2, j), y in b.items():
            if k == k2:
                want[i, j] = want.get((i, j), 0.0) + x * y
    got = {(r.i, r.j): r.v for r in la.gemm(make(a), make(b)).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    far = make({(0, 10_000): 1.0})
    assert la.gemm(make(a), far).count() == 0 and la.gemm(make(a).limit(0), make(b)).count() == 0


def test_large_small_operands_go_by_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(50)
    a, b = rng.random((30, 12)), rng.random((12, 9))
    monkeypatch.setattr(la, "SMALL_CELLS", 20)
    assert np.allclose(dense(la.gemm_small(rows_of(spark, a), table(spark, b), alpha=ALPHA), (30, 9)), ALPHA * a @ b, rtol=1e-9)
    assert np.allclose(dense(la.gemm_tall(rows_of(spark, a)), (12, 12)), a.T @ a, rtol=1e-9)
    assert np.allclose(dense(la.syrk_tall(rows_of(spark, a)), (12, 12)), np.triu(a.T @ a), rtol=1e-9)
