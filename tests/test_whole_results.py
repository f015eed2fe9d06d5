"""Results that are whole, and steps whose memory and work don't grow with copies."""

from pyspark.sql import functions as F

from tilewright.plans import links as lk
from tilewright.plans import search as se
from tilewright.queries import QUERIES
from tilewright.queries import planning as pl
from tilewright.queries import predictors as pq


def test_stream_bytes_have_three_policies(spark, sf_dir):
    got = {x.pid: (x.all_, x.remote, x.tiles) for x in QUERIES["cm22_stream_bytes"](spark, sf_dir).collect()}
    problems = pl.problems(spark, sf_dir).collect()
    assert len(problems) == len(got) > 0
    for p in problems:
        sizes = [8 * p.D1 * p.D3, 8 * p.D3 * p.D2, 8 * p.D1 * p.D2]
        far = [loc > 0 for loc in (p.loc_a, p.loc_b, p.loc_c)]
        assert got[p.pid] == (sum(sizes), sum(s for s, f in zip(sizes, far) if f), sum(-(-s // 10**6) * 10**6 for s in sizes))


def exchanges_by_pid(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "pid" in line]


def test_orders_of_a_problem_stay_in_its_row(spark, sf_dir):
    (one,) = exchanges_by_pid(QUERIES["cm23_best_reuse_transfer"](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in one


def test_tiles_of_a_problem_meet_in_its_task(spark, sf_dir):
    (one,) = exchanges_by_pid(QUERIES["tn3_best_benchmarked"](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in one


def test_equal_problems_are_searched_for_once(spark, sf_dir, monkeypatch):
    problems = pq.search_problems(spark, sf_dir)
    many = problems.where("pid < 20").crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("pid", F.col("pid") + 1000 * F.col("copy")).drop("copy")
    kinds = many.drop("pid").distinct().count()
    seen, split = spark.sparkContext.accumulator(0), se.split

    def counted(case, p, *rest):
        seen.add(len(p["D1"]))
        return split(case, p, *rest)

    monkeypatch.setattr(se, "split", counted)
    got = {x.pid: tuple(x)[1:] for x in se.best_split(many, lk.weighted(pl.link(spark, sf_dir)), pq.unit_lookup(spark), 4).collect()}
    assert len(got) == many.count() and seen.value == kinds < len(got)
    assert all(got[k % 1000] == v for k, v in got.items())
