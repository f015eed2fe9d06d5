"""Ranks, running sums, quantiles and as-of joins against plain Python, on even, hot, tied, null and empty groups."""

import glob
import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F
from tilewright.operators import ordering as od


def hot(n=4000, seed=1):
    """One group holds a third of the rows and more; values repeat; some keys and values are null."""
    rng = random.Random(seed)
    out = [(rng.choice(["a"] * 4 + ["b", "c", None]), rng.choice([7.0, rng.gauss(0, 1) * 10 ** rng.randrange(-5, 6), None]), k) for k in range(n)]
    return out + [("one", 3.5, -1), ("nulls", None, -2)]


def groups_of(data):
    groups = {}
    for k, v, i in data:
        groups.setdefault(k, []).append((v, i))
    return groups


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_ranks_and_running_sums(spark, ranges):
    data = hot()
    df = spark.createDataFrame(data, "k string, v double, i long").repartition(7)
    got = od.ranked(df, ["k"], [F.col("v"), F.col("i")], "place", ranges).collect()
    want = {}
    for k, rows in groups_of(data).items():
        for place, (_, i) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0.0, x[1])), 1):
            want[i] = (k, place)
    assert {r.i: (r.k, r.place) for r in got} == want and len(got) == len(data)
    sums = od.running(df, ["k"], [F.col("i")], {"n": F.lit(1), "s": F.col("v")}, ranges).collect()
    for k, rows in groups_of(data).items():
        mine, n, s = sorted((r.i, r.n, r.s) for r in sums if r.k == k), 0, 0.0
        for (i, a, b), (v, j) in zip(mine, sorted(rows, key=lambda x: x[1])):
            n, s = n + 1, s + (v or 0.0)
            assert (i, a) == (j, n) and b == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_ranks_of_a_whole_table_and_of_none(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(10_000), 3000)], "x long")
    got = od.ranked(df, [], [F.col("x").desc()], "place", 9).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.place)] == sorted((r.x for r in got), reverse=True) and sorted(r.place for r in got) == list(range(1, 3001))
    assert od.ranked(df.limit(0), [], [F.col("x")]).count() == 0
    with pytest.raises(ValueError):
        od.ranked(df.withColumn("rank", F.lit(1)), [], [F.col("x")])


def test_no_task_ranks_a_hot_group(spark):
    df = spark.range(40_000).select((F.col("id") % 1000).alias("v"), F.col("id").alias("i"), F.lit("all").alias("k"))
    rows = od.ranged(df, ["k"], [F.col("v"), F.col("i")], 20)
    sizes = [r["count"] for r in rows.groupBy(od.RANGE).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 2000


def plain_quantile(values, share):
    values = sorted(values)
    p = (len(values) - 1) * share
    low, high = values[math.floor(p)], values[math.ceil(p)]
    return low if low == high else low + (p - math.floor(p)) * (high - low)


SHARES = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("bracket", [2, 50, 1 << 14])
def test_quantiles_by_selection(spark, monkeypatch, bracket):
    monkeypatch.setattr(od, "CUTS", 16)
    data = hot(6000, 3) + [("same", 2.0, k) for k in range(300)] + [("skewed", float(np.exp(x)), k) for k, x in enumerate(np.linspace(-300, 300, 1500))] + [("two", float(k % 2), k) for k in range(501)]
    df = spark.createDataFrame(data, "k string, v double, i long")
    got = {r.k: (r.n, r.q) for r in od.quantiles(df, ["k"], "v", SHARES, bracket).collect()}
    want = {k: [v for v, _ in rows if v is not None] for k, rows in groups_of(data).items()}
    assert got.keys() == {k for k, v in want.items() if v}
    for k, (n, q) in got.items():
        assert n == len(want[k])
        assert q == pytest.approx([plain_quantile(want[k], s) for s in SHARES], rel=1e-12)


def test_quantiles_of_nothing_whole_tables_and_ends(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (-0.0,), (0.0,), (-5e300,)], "v double")
    assert od.quantiles(df, [], "v", [0.0, 0.5, 1.0]).first()[:] == (5, [-5e300, 0.0, float("inf")])
    assert od.quantiles(df.limit(0), [], "v", [0.5]).count() == 0
    assert od.quantiles(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), [], "v", [1.0]).first()[:] == (1, [1.0])


def test_brackets_bound_what_is_ranked(spark):
    """One group of 10^6 values: what meets in a ranking task is a few thousand of them."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.xxhash64("id") % 10_000_019).cast("double").alias("v"))
    seen, real = [], od._ranked_inside
    od._ranked_inside = lambda rows, targets: seen.append(od._inside(rows, targets).groupBy("t").count().agg(F.max("count")).first()[0]) or real(rows, targets)
    try:
        got = od.quantiles(df, ["k"], "v", [0.25, 0.5, 0.75]).first()
    finally:
        od._ranked_inside = real
    assert max(seen) <= od.BRACKET < 20_000
    assert got.q == df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]


@pytest.mark.parametrize("ranges", [1, 6, 50])
def test_asof_join(spark, ranges):
    rng = random.Random(5)
    key = lambda: rng.choice(["a"] * 5 + ["b", None, "left only"])
    left = [(key(), rng.choice([rng.randrange(0, 900), 5, None]), k) for k in range(3000)]
    right = [(rng.choice(["a"] * 3 + ["b", None, "right only"]), rng.choice([rng.randrange(100, 800), 450, None]), rng.randrange(50), "x") for _ in range(2500)]
    l, r = spark.createDataFrame(left, "k string, t int, i long").repartition(5), spark.createDataFrame(right, "k string, t long, v int, w string").repartition(3)
    got = od.asof_join(l, r, ["k"], "t", ["v", "w"], ranges).collect()
    best = {}
    for k, t, v, w in right:
        if t is not None:
            best.setdefault(k, {})[t] = max(best.get(k, {}).get(t, (v, w)), (v, w))
    want = []
    for k, t, i in left:
        times = sorted(best.get(k, {}))
        if t is None or not times:
            want.append((k, t, i, None, None, None))
        else:
            at = times[max(0, bisect_right(times, t) - 1)]
            want.append((k, t, i, at, *best[k][at]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)
    assert od.asof_join(l.limit(0), r, ["k"], "t", ["v"]).count() == 0 and od.asof_join(l, r.limit(0), ["k"], "t", ["v"]).where("v IS NOT NULL").count() == 0


def test_asof_join_of_a_million_lookup_rows_under_one_key(spark):
    right = spark.range(1_000_000).select(F.lit(0).alias("k"), (3 * F.col("id") + 10).alias("t"), F.col("id").alias("v"))
    left = spark.range(50_000).select(F.lit(0).alias("k"), (F.col("id") * 61).alias("t"))
    got = od.asof_join(left, right, ["k"], "t", ["v"], 16)
    assert got.where("v <> greatest(0, least(999999, (t - 10) div 3)) OR t < 10 AND v <> 0").isEmpty() and got.count() == 50_000


def test_ordered_part_files(spark, tmp_path):
    df = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("value"))
    od.write_ordered(df, [F.col("value").desc()], f"file://{tmp_path}/o", 6)
    files = sorted(glob.glob(f"{tmp_path}/o/part-*"))
    lines = [x for f in files for x in open(f).read().split()]
    assert len(files) > 2 and lines == sorted(lines, reverse=True) and len(lines) == 5000
