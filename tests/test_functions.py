import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tilewright.functions import metrics as mt
from tilewright.plans import models as cm
from tilewright.plans import tuner as tn


def plain_near(values, tolerance=0.05):
    out, done = list(values), [False] * len(values)
    for i in range(len(values)):
        group = [k for k in range(len(values)) if not done[k] and abs(out[k] - out[i]) < tolerance * abs(out[i])]
        mean = sum(out[k] for k in group) / max(1, len(group))
        for k in group:
            out[k], done[k] = mean, True
    return out


def test_near_groups(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([1.0, 1.04, 1.1, 2.0, 2.09, -1.0, 0.0]) * rng.choice([1, 1.02]) for _ in range(rng.randrange(0, 12))]) for k in range(60)]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k int, v array<double>").select("k", mt.near_groups(F.col("v")).alias("v")).collect()}
    for k, v in rows:
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[k], plain_near(v))) and len(got[k]) == len(v)


def test_means_and_errors(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0)], "x double")
    h, g, m = df.agg(mt.harmonic_mean(F.col("x")), mt.geometric_mean(F.col("x")), mt.mape(-F.col("x"))).first()
    assert abs(h - 3 / 1.75) < 1e-12 and abs(g - 2) < 1e-12 and abs(m - 7 / 3) < 1e-12
    bands = spark.createDataFrame([(x,) for x in (201.0, 200.0, 55.0, 50.0, 25.0, -25.0, -26.0, -50.0, -51.0, -200.0)], "x double")
    assert [r[0] for r in bands.select(mt.error_band(F.col("x"))).collect()] == [3, 2, 0, 1, 0, 0, 1, 1, 2, 2]
    with pytest.raises(PySparkException):
        spark.range(1).select(mt.level_of(F.lit("Cgemm"))).collect()


def plain_roofline(m, n, k, d, locs):
    compute, speed = 2 * m * n * k / 1e12 / (6.9 * d), [min(4, d) * 13 if x == -1 else (d - 1) * 24 for x in locs]
    if 0 in speed:
        return 0.0
    transfer = sum(8 * c / 1e9 / s for c, s in zip((m * k, n * k, m * n), speed))
    return 2 * m * n * k / 1e12 / max(compute, transfer) * 0.9


def test_roofline_takes_each_operand_over_its_link(spark):
    rows = [(m, 2048, k, d, a, b, -1) for m in (512, 8192) for k in (256, 16384) for d in (1, 2, 8) for a in (-1, 0) for b in (-1, 1)]
    df = spark.createDataFrame(rows, "m long, n long, k long, d int, a int, b int, c int")
    for r in df.withColumn("x", mt.roofline(*map(F.col, df.columns))).collect():
        assert r.x == pytest.approx(plain_roofline(r.m, r.n, r.k, r.d, (r.a, r.b, r.c)), rel=1e-12)


def test_nothing_divides_by_zero(spark):
    z = spark.createDataFrame([(0.0, 3.0), (2.0, 3.0)], "z double, x double")
    z0 = F.col("z")
    got = z.select(mt.gflops(F.col("x"), z0), mt.power_delay(F.col("x"), z0), mt.percentage_error(F.col("x"), z0), mt.rate(F.col("x"), z0), mt.energy_delay(F.col("x"), z0, F.lit(1))).collect()
    assert set(got[0]) == {None} and None not in got[1]
    assert z.agg(mt.harmonic_mean(z0), mt.geometric_mean(z0)).first()[:] == (0.0, 0.0)
    long = spark.createDataFrame([("[512|" + "0" * 2_000_000 + "1.5|2.5]",)], "p string")
    assert long.select(*mt.struct_fields(F.col("p"))).first()[:] == (512, 1.5, 2.5)


def test_distributions_give_all_tasks_once(spark):
    scores = spark.createDataFrame([(p, u, s, n) for p, n in ((1, 13), (2, 7)) for u, s in enumerate((0.5, 0.0, 0.3, 0.2))], "pid int, unit int, score double, n long")
    quota = tn.quotas(scores)
    want = {(r.pid, r.unit): r.quota for r in quota.collect()}
    assert sum(q for (p, _), q in want.items() if p == 1) == 13
    for strategy in ("round_robin", "contiguous", "chunked", "chunked_reverse"):
        got = tn.distribute(quota, strategy, 3).collect()
        assert sorted(r.sk for r in got if r.pid == 1) == list(range(13))
        assert all(sum((r.pid, r.unit) == k for r in got) == q for k, q in want.items())
    with pytest.raises(ValueError):
        tn.distribute(quota, "other")


def test_windows_by_buckets_are_the_nested_loop(spark):
    rng = random.Random(31)
    shapes = [(n, n, k) for n in (1, 2, 3, 7, 64, 100, 256, 1000) for k in (1, 2, 3, 5, 50, 64, 500, 2000)] + [(5, 6, 7), (0, 0, 4), (4, 4, 0)]
    runs = [(k, *rng.choice(shapes), *(rng.randrange(2) for _ in range(3))) for k in range(900)]
    windows = [(*(rng.randrange(2) for _ in range(3)), rng.choice([1.0, 2.0, 8.0, 64.0, 100.0, rng.uniform(1, 1500)]), rng.choice([1.0, 0.125, 8.0, 27 / 8, rng.uniform(0.01, 50)])) for _ in range(1500)]
    windows += windows[:100] + [(0, 0, 0, 0.0, 1.0), (0, 0, 0, 1.0, -1.0)]
    want = set()
    for i, m, n, k, *at in runs:
        for *where, size, ratio in windows:
            if at == where and m == n > 0 < k and size > 0 < ratio and m * n * k <= size**3 and (m + 1) * (n + 1) * (k + 1) >= (size - 1) ** 3 and k * ratio <= n <= (k + 1) * ratio:
                want.add(i)
    df = spark.createDataFrame(runs, "i int, M long, N long, K long, a_loc int, b_loc int, c_loc int")
    found = mt.in_windows(df, spark.createDataFrame(windows, "a_loc int, b_loc int, c_loc int, size double, ratio double"))
    got = [r.i for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < 900
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
