"""Student's t quantiles, and the sample at which a measurement may stop."""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log, log1p, pi, sqrt, tan
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordering import running
from tilewright.sources.paths import small_side, staged

#: A run stops after more than so many samples, once the interval's half-width is so much of the mean.
LEAST_SAMPLES, SHARE, ALPHA = 10, 0.05, 0.05


def _log_ratio(a: float) -> float:
    """ln gamma(a + 1/2) - ln gamma(a), without the cancellation of large ones."""
    if a < 30:
        return lgamma(a + 0.5) - lgamma(a)
    return 0.5 * log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def central(t: float, freedom: float) -> float:
    """P(|T| < t): the incomplete beta function I_y(1/2, freedom / 2) at y = t^2 / (freedom + t^2), by its series of positive terms."""
    a, y = freedom / 2, t * t / (freedom + t * t)
    term = total = 1.0
    k = 0
    while term > 1e-17 * total and k < 1_000_000:
        term *= y * (a + 0.5 + k) / (1.5 + k)
        total += term
        k += 1
    return 2 / sqrt(pi) * exp(_log_ratio(a) + 0.5 * log(y) - a * log1p(t * t / freedom)) * total if t else 0.0


@lru_cache(1 << 16)
def quantile(freedom: int, alpha: float = ALPHA) -> float:
    """The t that |T| exceeds with probability ``alpha``: the incomplete beta function inverted by Newton steps within a bracket."""
    if freedom < 1:
        return float("nan")
    if freedom == 1:
        return tan(pi / 2 * (1 - alpha))
    if freedom == 2:
        return sqrt(2) * (1 - alpha) / sqrt(alpha * (2 - alpha))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    t = z + (z**3 + z) / (4 * freedom) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * freedom**2)
    low, high = z, float("inf")
    for _ in range(100):
        over = central(t, freedom) - (1 - alpha)
        low, high = (low, min(high, t)) if over > 0 else (max(low, t), high)
        slope = 2 * exp(_log_ratio(freedom / 2) - (freedom + 1) / 2 * log1p(t * t / freedom)) / sqrt(freedom * pi)
        step = t - over / slope
        if not low <= step <= high:
            step = (low + min(high, 2 * t)) / 2
        if abs(step - t) <= 1e-15 * t:
            return step
        t = step
    return t


def student(freedom: Column, alpha: float = ALPHA) -> Column:
    """A column of quantiles, each of the degrees that a batch has made once; null below 1."""

    @F.pandas_udf("double")
    def values(n: pd.Series) -> pd.Series:
        each, place = np.unique(n.fillna(0).astype("int64"), return_inverse=True)
        return pd.Series(np.array([quantile(int(x), alpha) for x in each])[place]).where(n.fillna(0).to_numpy() >= 1)

    return values(freedom)


def error_margins(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """``(*by, n, margin)``: half of the interval's width over the mean, t sd / sqrt(n) / mean with the deviation over n; null for one value."""
    x = F.col(value)
    seen = df.groupBy(*by).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("_sd"), F.avg(x).alias("_mean"))
    return seen.select(*by, "n", F.try_divide(student(F.col("n") - 1, alpha) * F.col("_sd") / F.sqrt("n"), F.col("_mean")).alias("margin"))


def bounds(freedom: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """Columns of a value below each degree's quantile and of one above, those of the powers of two around it; null below 1."""
    powers = F.array(*(F.lit(quantile(1 << k, alpha)) for k in range(53)))
    place = F.floor(F.log2(freedom.cast("double"))).cast("int") + 1
    # a rounded logarithm may be one off where the two powers' quantiles are equal to all digits but the last ones
    at = lambda k: F.when(freedom >= 1, F.element_at(powers, k))
    return at(place + 1) * (1 - 1e-12), at(place) * (1 + 1e-12)


def stopping(df: DataFrame, by: list[str], order: list[str], value: str, share: float = SHARE, least: int = LEAST_SAMPLES, alpha: float = ALPHA, ranges: int | None = None) -> DataFrame:
    """``(*by, samples, n, mean, margin)``: where a run over each group's samples in ``order`` stops.

    ``n`` is the first number of samples over ``least`` whose margin is at most ``share``, with the mean and margin that these have;
    null where none is. Null samples aren't taken; samples equal in ``order`` come by value. Moments run over ranges of the order, so
    one group may have all samples; they are taken about the group's mean, which keeps their digits.

    A range at whose end a margin is surely small enough is a group's last one that matters. Up to there only samples whose margin two
    simple bounds leave open, before the first that both allow, need a quantile.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*by, *order, x.alias("_x"))
    centre = staged(rows.groupBy(*by).agg(F.avg("_x").alias("_c"), F.count("*").alias("samples")), "centre")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    centred = rows.alias("r").join(small_side(centre).alias("c"), same("r", "c")).select("r.*", "_c")
    mean = F.col("_c") + F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))))
    half = F.try_divide(sd / F.sqrt("n"), mean)
    low, high = bounds(F.col("n") - 1, alpha)
    stops = lambda t: (F.col("n") > least) & (half * t <= share)
    d = F.col("_x") - F.col("_c")
    run = running(centred, [*by, "_c"], [*map(F.col, order), F.col("_x")], {"n": F.lit(1).cast("long"), "s": d, "q": d * d}, ranges, until=stops(high))
    near = run.where(stops(low)).select(*by, "n", mean.alias("mean"), half.alias("_m"), stops(high).alias("_sure"))
    sure = staged(near.where("_sure").groupBy(*by).agg(F.min("n").alias("_first")), "sure")
    tried = near.alias("h").join(small_side(sure).alias("s"), same("h", "s"), "left").where(F.col("_first").isNull() | (F.col("n") <= F.col("_first"))).select("h.*")
    # written, or the quantile would be asked for before the join leaves samples out
    tried = staged(tried, "tried").withColumn("margin", student(F.col("n") - 1, alpha) * F.col("_m"))
    first = tried.where(F.col("margin") <= share).groupBy(*by).agg(F.min(F.struct("n", "mean", "margin")).alias("f"))
    return centre.alias("c").join(first.alias("f"), same("c", "f"), "left").select(*(F.col(f"c.{k}") for k in by), "samples", "f.f.*")
