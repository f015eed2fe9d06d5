import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from tilewright.functions import student as st

#: Published quantiles of the two-sided 5 %.
PUBLISHED = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 5: 2.570581836, 10: 2.228138852, 30: 2.042272456, 100: 1.983971519, 1000: 1.962339081}


def test_published_quantiles():
    assert all(abs(st.quantile(n) - t) < 1e-9 for n, t in PUBLISHED.items())
    assert math.isnan(st.quantile(0)) and st.quantile(10**6) == pytest.approx(1.959966354, abs=1e-8)


@pytest.mark.parametrize("freedom", [1, 2, 3, 4, 7, 11, 30, 31, 32, 99, 500, 4999, 10**5, 10**6])
@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.001])
def test_quantiles_by_integrating_the_density(freedom, alpha):
    t = st.quantile(freedom, alpha)
    x, w = np.polynomial.legendre.leggauss(200)
    # t = sqrt(f) tan(u) makes the density a power of a cosine; its whole integral is the norm
    end = math.atan(t / math.sqrt(freedom))
    power = lambda u: np.exp((freedom - 1) * np.log(np.cos(u)))
    part = (w * power((x + 1) / 2 * end)).sum() * end / 2
    whole = math.sqrt(math.pi) / 2 * math.exp(math.lgamma(freedom / 2) - math.lgamma((freedom + 1) / 2)) if freedom < 1000 else math.sqrt(math.pi) / 2 * math.exp(-st._log_ratio(freedom / 2))
    assert part / whole == pytest.approx(1 - alpha, abs=1e-9)


def test_quantiles_fall_to_the_normal_one():
    t = [st.quantile(n) for n in (*range(1, 200), 300, 1000, 10**4, 10**5, 10**6)]
    assert all(a > b for a, b in zip(t, t[1:])) and t[-1] > statistics.NormalDist().inv_cdf(0.975)


def test_column(spark):
    df = spark.createDataFrame([(n,) for n in (1, 30, 31, 31, 0, -1, None, 1000)], "n long")
    got = {r.n: r.t for r in df.select("n", st.student(F.col("n")).alias("t")).collect()}
    assert got[31] == st.quantile(31) and got[1] == st.quantile(1) and got[0] is got[-1] is got[None] is None


def plain_stop(values, least=10, share=0.05):
    for n in range(least + 1, len(values) + 1):
        x = values[:n]
        mean = statistics.fmean(x)
        margin = st.quantile(n - 1) * statistics.pstdev(x) / math.sqrt(n) / mean if mean else None
        if margin is not None and margin <= share:
            return n, mean, margin
    return None


@pytest.mark.parametrize("ranges", [1, 9])
def test_stopping_is_the_loops(spark, ranges):
    rng = random.Random(8)
    runs = {"still": [3.0] * 40, "few": [1.0, 2.0] * 5, "never": [10.0 ** rng.randrange(6) for _ in range(80)], "at once": [100 + rng.random() for _ in range(60)], "large": [1e6 + rng.gauss(0, 2e5) for _ in range(300)], None: [rng.uniform(1, 9) for _ in range(900)]}
    rows = [(k, i, x, "extra") for k, v in runs.items() for i, x in enumerate(v)] + [("few", 99, None, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "b string, i int, x double, y string")
    got = {r.b: r for r in st.stopping(df, ["b"], ["i"], "x", ranges=ranges).collect()}
    assert got.keys() == runs.keys()
    for k, v in runs.items():
        want = plain_stop(v)
        assert got[k].samples == len(v) and (got[k].n is None) == (want is None), k
        if want:
            assert got[k].n == want[0] and got[k].mean == pytest.approx(want[1], rel=1e-12) and got[k].margin == pytest.approx(want[2], rel=1e-7, abs=1e-12)
    assert st.stopping(df.limit(0), ["b"], ["i"], "x").count() == 0
    margins = {r.b: r.margin for r in st.error_margins(df, ["b"], "x").collect()}
    assert margins["large"] == pytest.approx(st.quantile(299) * statistics.pstdev(runs["large"]) / math.sqrt(300) / statistics.fmean(runs["large"]), rel=1e-9)
