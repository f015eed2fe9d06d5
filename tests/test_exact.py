import math
import random
from fractions import Fraction

import numpy as np
import pytest
from tilewright.operators import exact as ex


def numbers(n, seed=1):
    rng = random.Random(seed)
    wide = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-300, 300) for _ in range(n)]
    return wide + [-x for x in wide[::3]] + [5e-324, -5e-324, 1e-310, 1.7e308, -1.7e308, 0.0, -0.0, 0.1, 1 / 3]


def test_parts_add_up_exactly():
    x = np.array(numbers(500) + [sign * 2.0**e for e in range(-1074, 1024, 13) for sign in (-1, 1)])
    place, bins, values = ex.parts(x)
    got = [Fraction(0)] * len(x)
    for p, b, v in zip(place.tolist(), bins.tolist(), values.tolist()):
        got[p] += Fraction(v) * Fraction(2) ** (ex.WIDTH * b - ex.BASE)
    assert got == [Fraction(v) for v in x.tolist()] and np.abs(values).max() < 1 << ex.WIDTH


def test_products_are_split_without_loss():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal(400) * 2.0 ** rng.integers(-200, 200, 400), rng.standard_normal(400) * 2.0 ** rng.integers(-200, 200, 400)
    p = ex.products(x, y)
    assert [Fraction(a) + Fraction(b) for a, b in zip(p[:400].tolist(), p[400:].tolist())] == [Fraction(a) * Fraction(b) for a, b in zip(x.tolist(), y.tolist())]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_the_same_bits_for_any_partitioning(spark, partitions):
    x = numbers(3000, 3)
    rows = [(k, k % 5 if k % 7 else None, v) for k, v in enumerate(x)] + [(-1, 2, None), (-2, 77, None)]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "i long, k int, v double").repartition(partitions)
    assert ex.exact_sum(df, [], "v").first().v == math.fsum(x)
    want = {}
    for _, k, v in rows:
        want.setdefault(k, []).append(v or 0.0)
    assert {r.k: r.v for r in ex.exact_sum(df, ["k"], "v").collect()} == {k: math.fsum(v) for k, v in want.items()}
    y = {k: random.Random(k).uniform(-1e3, 1e3) for k in range(len(x))}
    small = {k: v for k, v in enumerate(x) if 1e-100 < abs(v) < 1e100 or v == 0}
    a, b = (spark.createDataFrame([(k, float(v)) for k, v in m.items()], "i long, v double").repartition(partitions) for m in (small, y))
    assert ex.exact_dot(a, b, 7.5).first().v == float(sum((Fraction(v) * Fraction(y[k]) for k, v in small.items()), Fraction(7.5)))


def test_ends(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    one = lambda *v: ex.exact_sum(make(*v), [], "v").first().v
    assert one() == 0.0 and one(None) == 0.0 and one(math.inf, 1.0) == math.inf and one(-math.inf) == -math.inf and math.isnan(one(math.inf, -math.inf)) and math.isnan(one(math.nan, 1.0))
    assert one(1.7e308, 1.7e308) == math.inf and one(1.7e308, 1.7e308, -1.7e308) == 1.7e308 and one(5e-324, 5e-324) == 1e-323
    assert ex.exact_sum(make().withColumnRenamed("v", "k").selectExpr("k", "k AS v"), ["k"], "v").count() == 0
