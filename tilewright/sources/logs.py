"""Benchmark logs: headerless comma-separated text of fixed schemas, and link models.

A wrong number or kind of fields is fatal. Part of the schema is in the file names:
routine, device, flags, link ends; ids can be negative (``dev--1``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTROL = "T long, dev_num int, dev_id_token long, cachesize_limit long"
_RUN = f"{_CONTROL}, trans_a string, trans_b string, alpha double, beta double, M long, N long, K long, a_loc int, b_loc int, c_loc int, c_out_loc int, timer double"
_TAIL = "mean_t double, w_avg double, joules double, margin_err double, samples long, bench_t double"

#: The logs' columns in order.
SCHEMAS = {
    "lookup_l3": f"trans_a string, trans_b string, T long, N long, K long, {_TAIL}",
    "lookup_l2": f"trans_a string, T long, N long, {_TAIL}",
    "lookup_l1": f"T long, {_TAIL}",
    "bench_l3": f"M long, N long, K long, {_TAIL}",
    "bench_l2": f"M long, N long, {_TAIL}",
    "bench_l1": f"N long, {_TAIL}",
    "link": "dim1 int, dim2 int, transfer_t double, error double, reps long, benchmark_t double",
    "link_overlap": "over_loc_dest int, over_loc_src int, transfer_t double, over_transfer_t double, over_reps long, benchmark_t double",
    "run16": _RUN,
    "run18": f"{_RUN}, pred_t double, pred_J double",
    "run_l2": f"{_CONTROL}, trans_a string, alpha double, beta double, M long, N long, inc1 long, inc2 long, a_loc int, x_loc int, y_loc int, y_out_loc int, timer double, pred_t double, pred_J double",
    "run_l1": f"{_CONTROL}, alpha double, N long, inc1 long, inc2 long, x_loc int, y_loc int, x_out_loc int, y_out_loc int, timer double",
    "prediction": "model string, dev int, func string, flag0 string, trans_a string, trans_b string, M long, N long, K long, a_loc int, b_loc int, c_loc int, a_out int, b_out int, c_out int, lda long, ldb long, ldc long, pred string, inference_t double",
    "trace": "src int, dest int, route string, bytes long, fire_t double, sced_t double, complete_t double",
}
#: Columns that are kept of logs that are read by position.
KEPT = {
    "lookup_l3": ["trans_a", "trans_b", "T", "mean_t", "w_avg"],
    "validation": ["T", "dev_num", "dev_id_token", "trans_a", "trans_b", "M", "N", "K", "a_loc", "b_loc", "c_loc", "c_out_loc", "timer", "pred_t", "pred_J"],
    "prediction": ["dev", "func", "trans_a", "trans_b", "M", "N", "K", "a_loc", "b_loc", "c_loc", "pred"],
    "evaluation": ["M", "N", "K", "a_loc", "b_loc", "c_loc", "dev_num", "timer"],
}


def read(spark: SparkSession, path: str | list[str], kind: str, keep: str | None = None) -> DataFrame:
    """A log of a kind of :data:`SCHEMAS`, with its file's path; ``keep`` names a selection of columns."""
    df = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).csv(path)
    return df.select(*KEPT[keep]) if keep else df.select("*", F.col("_metadata.file_path").alias("file"))


def from_name(pattern: str, kind: str = "string") -> Column:
    return F.regexp_extract("file", pattern, 1).cast(kind)


def read_benchmarks(spark: SparkSession, path: str, level: int = 3) -> DataFrame:
    """Micro-benchmark logs below ``path``, with routine, device and flags from the names."""
    df = read(spark, path, f"bench_l{level}")
    flags = [from_name(f"_Trans{x}-([NT])").alias(f"trans_{x.lower()}") for x in ("AB" if level == 3 else "A" if level == 2 else "")]
    return df.select(from_name(r"cublas(\w+?)_dev-").alias("func"), from_name(r"_dev-(-?\d+)", "int").alias("dev"), *flags, *[c for c in df.columns if c != "file"])


def read_links(spark: SparkSession, path: str, kind: str = "link") -> DataFrame:
    """Link benchmarks below ``path``, with ends from the names, and bytes of the square."""
    df = read(spark, path, kind)
    out = df.select(from_name(r"_to-(-?\d+)_", "int").alias("dest"), from_name(r"_from-(-?\d+)_", "int").alias("src"), *[c for c in df.columns if c != "file"])
    return out.withColumn("bytes", F.col("dim1").cast("long") * F.col("dim2") * 8) if kind == "link" else out


def read_link_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(dest, src, ti, tb)`` and ``(dest, src, osrc, odest, sl)`` from link-model texts.

    Slowdowns are brought into range: under 0.95 and within 5 % of 1 to 1, over 2 to 2.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    ends = [from_name(r"_to-(-?\d+)_", "int").alias("dest"), from_name(r"_from-(-?\d+)_", "int").alias("src")]
    number = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit("")).cast("double")
    models = lines.groupBy(*ends).agg(F.max(number(r"^Intercept: (\S+)")).alias("ti"), F.max(number(r"^Coefficient: (\S+)")).alias("tb"))
    slow = lines.where(F.col("value").startswith("Slowdown")).select(
        *ends, F.regexp_extract("value", r"\[(-?\d+)\]->", 1).cast("int").alias("osrc"), F.regexp_extract("value", r"->\[(-?\d+)\]", 1).cast("int").alias("odest"),
        clamped_slowdown(number(r": (\S+)$")).alias("sl"),
    )
    return models, slow


def clamped_slowdown(sl: Column) -> Column:
    return F.when(sl < 0.95, 1.0).when(sl > 2, 2.0).when(F.abs(sl - 1) <= 0.05, 1.0).otherwise(sl)


def local_link(units: list[int], spark: SparkSession) -> DataFrame:
    """The link of each unit to itself: no latency, no time a byte."""
    return spark.createDataFrame([(u, u, 0.0, 0.0) for u in units], "dest int, src int, ti double, tb double")


def hashed_uniform(index: Column, seed: int) -> Column:
    """A number in [0, 1) from an index and a seed by integer arithmetic alone, so that any engine repeats it."""
    m = 2147483647
    x = (F.pmod(index, F.lit(m)) * 48271 + seed * 69621) % m
    x = (x * 48271 + 11) % m
    return (x * 16807 % m) / F.lit(float(m))
