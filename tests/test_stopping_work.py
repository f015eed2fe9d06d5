"""How much work the stopping rule does, beside its results in ``test_student``."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import student as st
from tilewright.operators import ordering as od


@pytest.mark.parametrize("alpha", [0.05, 0.001])
def test_bounds_enclose_the_quantile(spark, alpha):
    degrees = [*range(1, 70), 127, 128, 129, 4095, 4096, 4097, 10**6, 2**40, 10**14]
    rows = spark.createDataFrame([(n,) for n in [0, *degrees]], "n long")
    got = {x.n: (x.low, x.high) for x in rows.select("n", *(c.alias(k) for c, k in zip(st.bounds(F.col("n"), alpha), ("low", "high")))).collect()}
    assert got[0] == (None, None)
    for n in degrees:
        assert got[n][0] <= st.quantile(n, alpha) <= got[n][1], n
        assert n < 256 or got[n][1] / got[n][0] < 1.02


def test_few_samples_need_a_quantile(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(b, i, rng.uniform(1, 50)) for b in range(2) for i in range(3000)]
    asked = spark.sparkContext.accumulator(0)

    def counted(freedom, alpha):
        @F.pandas_udf("double")
        def values(n: pd.Series) -> pd.Series:
            asked.add(len(n))
            return pd.Series([st.quantile(int(x), alpha) for x in n])

        return values(freedom)

    monkeypatch.setattr(st, "student", counted)
    got = st.stopping(spark.createDataFrame(rows, "b int, i int, x double"), ["b"], ["i"], "x", ranges=8).collect()
    assert {x.b for x in got} == {0, 1} and all(x.samples == 3000 and 300 < x.n < 1000 for x in got)
    assert 2 <= asked.value < 100


def test_ranges_behind_the_end_are_left_out(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    run = od.running(df, ["k"], [F.col("id")], {"n": F.lit(1).cast("long")}, 20, until=F.col("n") >= 60)
    got = run.collect()
    for k in (0, 1):
        n = sorted(x.n for x in got if x.k == k)
        assert n == list(range(1, len(n) + 1)) and 60 <= len(n) < 250
