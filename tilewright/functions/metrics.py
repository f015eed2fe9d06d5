"""Column functions of the performance analytics: work, rates, errors, classes.

A rate over no time, an error of nothing measured and the like are null; aggregates leave nulls out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flops_run(m: Column, n: Column, k: Column) -> Column:
    """Work of a gemm as run analysis counts it: M N (2K + 2)."""
    return m * n * (2 * k + 2)


def flops_evaluation(m: Column, n: Column, k: Column) -> Column:
    """As the evaluation counts it: M N (2K + 1)."""
    return m * n * (2 * k + 1)


def flops_roofline(m: Column, n: Column, k: Column) -> Column:
    """As the roofline counts it: 2 M N K."""
    return 2 * m * n * k


def gemm_bytes(m: Column, n: Column, k: Column) -> Column:
    return 8 * (m * (n + k) + n * k)


def gflops(flops: Column, seconds: Column) -> Column:
    return F.try_divide(flops, F.lit(1e9) * seconds)


def energy(seconds: Column, watts: Column, devices: Column) -> Column:
    return seconds * watts * devices


def power_delay(flops: Column, joules: Column) -> Column:
    """GFlop/J."""
    return F.try_divide(flops, F.lit(1e9) * joules)


def energy_delay(perf: Column, watts: Column, devices: Column) -> Column:
    return F.try_divide(perf * perf, watts * devices)


def location_code(a: Column, b: Column, c: Column) -> Column:
    return 100 * (a + 1) + 10 * (b + 1) + (c + 1)


def rate(amount: Column, seconds: Column, scale: float = 1.0) -> Column:
    """Billions a second, over ``scale`` (1024: the plots' Tflops)."""
    return F.try_divide(amount * F.lit(1e-9), seconds) / F.lit(scale)


def percentage_error(predicted: Column, measured: Column) -> Column:
    return F.try_divide(100 * (predicted - measured), measured)


def struct_fields(packed: Column) -> tuple[Column, Column, Column]:
    """T, ratio and prediction of a packed ``[T|ratio|t]``."""
    parts = F.split(packed.substr(F.lit(2), F.length(packed) - 2), r"\|")
    return parts[0].cast("long"), parts[1].cast("double"), parts[2].cast("double")


def device_token(device: Column) -> Column:
    return F.pow(F.lit(10), device).cast("long")


def devices_of(token: Column, most: int = 9) -> Column:
    """Unit ids of a base-10 token, one digit a unit."""
    digits = F.sequence(F.lit(0), F.lit(most))
    return F.filter(digits, lambda k: F.floor(token / F.pow(F.lit(10.0), k)) % 10 > 0)


def remote(location: Column, device: Column) -> Column:
    return (location != device).cast("int")


def cube_root_size(m: Column, n: Column, k: Column) -> Column:
    """Edge of the cube of equal volume, in thousands, cut off."""
    return F.floor(F.cbrt(m.cast("double") * n * k) / 1000 + 1e-12).cast("long")


#: The plotted machine's Tflop/s a unit, GB/s of a host channel, channels, GB/s between units, cost of going parallel.
UNIT_TFLOPS, HOST_GBS, HOST_CHANNELS, PEER_GBS, PARALLEL_COST = 6.9, 13.0, 4, 24.0, 0.1


def roofline(m: Column, n: Column, k: Column, devices: Column, a_loc: Column, b_loc: Column, c_loc: Column) -> Column:
    """Analytic Tflop/s of a gemm: its work over the larger of compute and transfer time.

    Each operand travels on its own: from the host (location -1) over as many channels as
    there are units, up to ``HOST_CHANNELS``; else from the other units. Without another
    unit an operand that lies on one has no link to come over: the rate is 0.
    """
    compute = flops_roofline(m, n, k) / F.lit(1e12) / (F.lit(UNIT_TFLOPS) * devices)
    speed = lambda loc: F.when(loc == -1, F.least(F.lit(HOST_CHANNELS), devices) * HOST_GBS).otherwise((devices - 1) * PEER_GBS)
    seconds = lambda cells, loc: F.try_divide(8 * cells / F.lit(1e9), speed(loc))
    transfer = seconds(m * k, a_loc) + seconds(n * k, b_loc) + seconds(m * n, c_loc)
    rate_ = flops_roofline(m, n, k) / F.lit(1e12) / F.greatest(compute, transfer) * (1 - PARALLEL_COST)
    return F.when(transfer.isNull(), F.lit(0.0)).otherwise(rate_)


def level_of(function: Column) -> Column:
    """BLAS level of a routine; an unknown one raises."""
    return F.when(function == "Daxpy", 1).when(function.isin("Dgemm", "Sgemm"), 3).otherwise(F.raise_error(F.concat(F.lit("unknown routine "), function)).cast("int"))


def routine_flops(function: Column, m: Column, n: Column, k: Column) -> Column:
    return F.when(function == "gemm", 2 * m * n * k).when(function == "gemv", 2 * m * n).when(function.isin("axpy", "dot"), 2 * n)


def shape_class(m: Column, n: Column, k: Column) -> Column:
    return F.when((m == n) & (n == k), "square").when((m == n) & (n > k), "fat-thin").when((m == n) & (n < k), "thin-fat")


def within_limits(m: Column, n: Column, k: Column) -> Column:
    volume = m.cast("double") * n * k
    return (volume >= 4096.0**3) & (m >= 1024) & (n >= 1024) & (k >= 1024) & (volume < 19457.0**3)


def is_small(m: Column, n: Column, k: Column) -> Column:
    return m.cast("double") * n * k <= 9200.0**3


def error_band(error: Column, digits: int = 9) -> Column:
    """3: beyond 200; 2: (55, 200] or [-200, -50); 1: (25, 50] or [-50, -25); else 0.

    Errors are taken to ``digits`` places, so that one that a division leaves a hair off an edge is on it.
    """
    error = F.round(error, digits)
    return (
        F.when(F.abs(error) > 200, 3)
        .when(((error > 55) & (error <= 200)) | ((error >= -200) & (error < -50)), 2)
        .when(((error > 25) & (error <= 50)) | ((error >= -50) & (error < -25)), 1).otherwise(0)
    )


def admissible(level: int, tile: Column, *dims: Column) -> Column:
    """Whether a tile is fit for validation: one and a half times in every dimension; at level 1 also 64 times at most."""
    if level == 1:
        return (tile >= dims[0] / 64) & (tile <= dims[0] / 1.5)
    return reduce(lambda a, b: a & b, [d / 1.5 >= tile for d in dims])


def in_shape_windows(runs: DataFrame, locations: DataFrame, sizes: list[int], fat: list[int], thin: list[int]) -> DataFrame:
    """Runs ``(M, N, K, a_loc, b_loc, c_loc)`` at one of the locations whose volume is that of a cube of one of ``sizes`` and whose
    shape is one of the ratios, with room for dimensions that were rounded down.
    """
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    ratios = [float(x) ** 3 / 8 for x in fat] + [8 / float(x) ** 3 for x in thin]
    grid = locations.select("a_loc", "b_loc", "c_loc", each(ratios).alias("ratio")).select("*", each([float(x) for x in sizes]).alias("size"))
    return in_windows(runs, grid)


#: Buckets of a window join for each doubling.
PER_OCTAVE = 2


def _bucket(x: Column, slack: float = 0.0) -> Column:
    return F.floor(F.log2(x) * PER_OCTAVE + slack).cast("int")


def in_windows(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs ``(M, N, K, a_loc, b_loc, c_loc)`` that fit one of ``windows`` ``(a_loc, b_loc, c_loc, size, ratio)``, each once.

    A run fits if it is at the location, its volume is the cube of ``size`` and N over K is ``ratio``, with room for
    dimensions that were rounded down, and M is N. Volumes and ratios fall into logarithmic buckets. Rounding down
    moves a volume by a factor of 8 at most and a ratio by 2, so a run has one bucket and a window the few that it can reach:
    an equi-join, whatever the number of windows, with the exact test behind it. Dimensions are 1 and more; others fit nothing.
    """
    m, n, k = F.col("M"), F.col("N"), F.col("K")
    names = ["a_loc", "b_loc", "c_loc"]
    reach = lambda low, high: F.explode(F.sequence(_bucket(low, -1e-6), _bucket(high, 1e-6)))
    some = windows.where("size > 0 AND ratio > 0").select(*(F.col(c).alias(f"_{c}") for c in names), F.col("size").cast("double").alias("_size"), F.col("ratio").cast("double").alias("_ratio")).distinct()
    some = some.select("*", reach(F.greatest(F.pow(F.col("_size") - 1, F.lit(3.0)) / 8, F.lit(1.0)), F.greatest(F.pow("_size", F.lit(3.0)), F.lit(1.0))).alias("_volume"))
    some = some.select("*", reach(F.col("_ratio"), 2 * F.col("_ratio")).alias("_shape"))
    volume = (k.cast("double") * m * n <= F.pow("_size", F.lit(3.0))) & ((k + 1).cast("double") * (m + 1) * (n + 1) >= F.pow(F.col("_size") - 1, F.lit(3.0)))
    shape = (n >= k * F.col("_ratio")) & (n <= (k + 1) * F.col("_ratio"))
    where = [F.col(c) == F.col(f"_{c}") for c in names]
    keys = (_bucket(k.cast("double") * m * n) == F.col("_volume")) & (_bucket(n / k) == F.col("_shape"))
    return runs.where((m == n) & (m > 0) & (k > 0)).join(some, reduce(lambda a, b: a & b, where) & keys & volume & shape, "left_semi")


def offload_class(*locations: Column) -> Column:
    ones = reduce(lambda a, b: a & b, [c == 1 for c in locations])
    some_one = reduce(lambda a, b: a | b, [c == 1 for c in locations])
    some_zero = reduce(lambda a, b: a | b, [c == 0 for c in locations])
    return F.when(ones, "full").when(some_one & some_zero, "partial").otherwise("none")


def harmonic_mean(x: Column) -> Column:
    """0 as soon as one value is 0; null without values."""
    return F.when(F.count_if(x == 0) > 0, F.lit(0.0)).otherwise(F.try_divide(F.count(x), F.sum(F.try_divide(F.lit(1.0), x))))


def geometric_mean(x: Column) -> Column:
    """0 as soon as one value is 0; null without values."""
    return F.when(F.count_if(x == 0) > 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(x))))


def mape(error: Column) -> Column:
    return F.avg(F.abs(error))


def near_groups(values: Column, tolerance: float = 0.05) -> Column:
    """Values nearer than ``tolerance`` to a pivot averaged together, in order of the array.

    Each place in turn is the pivot, with the value that it has by then; values not yet averaged that are
    nearer than the tolerance to it are. Returns the array with averages in place of the values. An
    ordered fold for short arrays; over a whole column there is :func:`near_value_means`.
    """
    start = F.struct(F.transform(values, lambda x: x.cast("double")).alias("v"), F.transform(values, lambda x: F.lit(False)).alias("done"))

    def step(state: Column, i: Column) -> Column:
        pivot = F.element_at(state["v"], i)
        joins = F.transform(F.sequence(F.lit(1), F.size(values)), lambda k: ~F.element_at(state["done"], k) & (F.abs(F.element_at(state["v"], k) - pivot) < tolerance * F.abs(pivot)))
        total = F.aggregate(F.zip_with(state["v"], joins, lambda v, j: F.when(j, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
        mean = F.try_divide(total, F.size(F.filter(joins, lambda j: j)))
        return F.struct(
            F.zip_with(state["v"], joins, lambda v, j: F.when(j, mean).otherwise(v)).alias("v"),
            F.zip_with(state["done"], joins, lambda d, j: d | j).alias("done"))

    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(1), F.size(values)), start, step)["v"]).otherwise(F.transform(values, lambda x: x.cast("double")))


def running_near(values: Column, tolerance: float = 0.05, parts: Column | int = 1) -> Column:
    """Each place in turn averaged with the later ones nearer to it than ``tolerance`` (times ``parts``), in place."""

    def step(v: Column, i: Column) -> Column:
        pivot = F.element_at(v, i)
        joins = F.transform(F.sequence(F.lit(1), F.size(v)), lambda k: (k == i) | ((k > i) & (F.abs(F.element_at(v, k) - pivot) < tolerance * parts * pivot)))
        total = F.aggregate(F.zip_with(v, joins, lambda x, j: F.when(j, x).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(v, joins, lambda x, j: F.when(j, total / F.size(F.filter(joins, lambda y: y))).otherwise(x))

    doubles = F.transform(values, lambda x: x.cast("double"))
    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(1), F.size(values)), doubles, step)).otherwise(doubles)


def near_value_means(df: DataFrame, keys: list[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """``(*keys, value, n, averaged)``: the groups of :func:`near_groups` over each key's values in ascending order.

    Equal values are counted before they meet, so a key's task gets its distinct values only, and takes
    them in one pass: a group's mean is the next pivot where it reaches a further value, else that value is. Values must
    not be negative.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))

    def means(group: pa.Table) -> pa.Table:
        group = group.sort_by(value)
        x, n = group.column(value).to_numpy(), group.column("n").to_numpy()
        out, low, pivot = np.empty(len(x)), 0, None
        while low < len(x):
            if pivot is None or not x[low] - pivot < tolerance * pivot:
                pivot = x[low]
            high = max(low + 1, low + int(np.searchsorted(x[low:] - pivot, tolerance * pivot, "left")))
            pivot = out[low:high] = float((x[low:high] * n[low:high]).sum() / n[low:high].sum())
            low = high
        return group.append_column("averaged", pa.array(out))

    kinds = ", ".join(f"`{c}` {t}" for c, t in counted.dtypes)
    return counted.groupBy(*keys).applyInArrow(means, f"{kinds}, averaged double")
