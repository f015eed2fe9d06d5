"""Writers of lookup tables, link models and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordering import write_ordered
from tilewright.sources.logs import SCHEMAS
from tilewright.sources.paths import staged

RUN_KEY = ["T", "dev_num", "dev_id_token", "cachesize_limit", "trans_a", "trans_b", "alpha", "beta", "M", "N", "K", "a_loc", "b_loc", "c_loc", "c_out_loc"]


def lines(df: DataFrame) -> DataFrame:
    """Rows as comma-separated text, doubles as ``%e``."""
    return df.select(F.concat_ws(",", *_parts(df)).alias("value"))


def _parts(df: DataFrame) -> list[Column]:
    return [F.format_string("%e", F.col(c)) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]


def write_lookup(benchmarks: DataFrame, path: str) -> None:
    """A lookup table in order of its first measured size: part files that follow each other, each sorted, whatever their number."""
    order = ["M" if "M" in benchmarks.columns else "N", *[c for c in ("trans_a", "trans_b") if c in benchmarks.columns]]
    text = lines(benchmarks.drop("func", "dev")).columns[0]
    rows = benchmarks.select(F.concat_ws(",", *_parts(benchmarks.drop("func", "dev"))).alias(text), *order)
    write_ordered(rows, [F.col(c) for c in order], path)


def link_model_lines(models: DataFrame, slowdowns: DataFrame) -> DataFrame:
    """``(dest, src, value)``: intercept, coefficient and slowdown lines of each link."""
    head = models.select("dest", "src", F.posexplode(F.array(F.format_string("Intercept: %e", "ti"), F.format_string("Coefficient: %e", "tb"))).alias("place", "value"))
    tail = slowdowns.select("dest", "src", F.lit(2).alias("place"), F.format_string("Slowdown([%d]->[%d]): %e", "osrc", "odest", "sl").alias("value"))
    return head.unionByName(tail)


def write_link_models(models: DataFrame, slowdowns: DataFrame, path: str) -> None:
    """Texts of link models in a folder for each link, named by its ends."""
    name = F.format_string("link_to-%d_from-%d_", "dest", "src")
    rows = link_model_lines(models, slowdowns).withColumn("link", name)
    rows.repartition("link").sortWithinPartitions("link", "place", "value").select("link", "value").write.partitionBy("link").text(path)


def append_run_log(runs: DataFrame, path: str, kind: str = "run18") -> None:
    """Rows appended to a run log, one line each. ``kind``: ``run18`` or ``run16`` (level 3), ``run_l2``, ``run_l1``."""
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
    runs.select(*names).write.mode("append").csv(path)


def append_new(runs: DataFrame, path: str, key: list[str] = RUN_KEY, kind: str = "run18") -> DataFrame:
    """Appends the rows whose key isn't in the log yet, once each; returns them.

    Null keys count as equal. Only a path that isn't there is taken for an empty log. The log is read before
    it is written: two writers at a time aren't kept apart.
    """
    spark = runs.sparkSession
    there = None
    try:
        there = spark.read.schema(SCHEMAS[kind]).csv(path).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh = runs.dropDuplicates(key)
    if there is not None:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        fresh = fresh.join(there, same, "left_anti")
    fresh = staged(fresh, "fresh")
    append_run_log(fresh, path, kind)
    return fresh


def write_benchmarks(benchmarks: DataFrame, path: str, level: int | None) -> None:
    """Micro-benchmark rows of level 3, 2 or 1, or of links (None), a folder for each log, named by what it is of.

    ``func, dev`` and the level's flags, or ``dest, src``, go into the name; the level's columns into the line.
    """
    if level is None:
        name, kind = F.format_string("linkbench_to-%d_from-%d_1.2.log", "dest", "src"), "link"
    else:
        flags = {3: ["trans_a", "trans_b"], 2: ["trans_a"], 1: []}[level]
        marks = "".join(f"_Trans{f[-1].upper()}-%s" for f in flags)
        name, kind = F.format_string(f"cublas%s_dev-%d{marks}_1.1.log", "func", "dev", *flags), f"bench_l{level}"
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
    text = benchmarks.select(name.alias("log"), F.concat_ws(",", *_parts(benchmarks.select(*names))).alias("value"))
    text.write.partitionBy("log").text(path)


def trace_lines(trace: DataFrame) -> DataFrame:
    """``src,dest,[ s d ],bytes,t0,t1,t2`` lines."""
    times = [F.col(c).cast("string") for c in ("fire_t", "sced_t", "complete_t")]
    return trace.select(F.concat_ws(",", F.col("src").cast("string"), F.col("dest").cast("string"), "route", F.col("bytes").cast("string"), *times).alias("value"))


def plan_token(tile: Column, units: Column, cache_limit: Column) -> Column:
    """``T,unit_num,token,cache_limit``."""
    token = F.aggregate(units, F.lit(0).cast("long"), lambda s, u: s + F.pow(F.lit(10), u).cast("long"))
    return F.concat_ws(",", tile.cast("string"), F.size(units).cast("string"), token.cast("string"), cache_limit.cast("string"))
