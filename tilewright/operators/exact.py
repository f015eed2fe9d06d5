"""Sums and inner products whose bits don't hang on the order or the partitioning.

A double is an integer mantissa times a power of two. Its mantissa is laid over bins of ``WIDTH`` binary
digits; integers are summed by bin, partially and then finally like any aggregate, and those sums
are exact, so in any order the same. Only the end rounds, once and to nearest: the result is the double nearest
to the exact sum. Products are split into their rounded value and its error before, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary digits of a bin; a part of a mantissa is below 2^WIDTH, so a long holds the sum of 2^(63 - WIDTH) of them.
WIDTH = 32
#: The exponent of the least bit of any double, -1074, is at the begin of bin 0.
BASE = 1074
#: What a sum holds that has no finite value: the bins of infinities and of NaN.
PLUS, MINUS, NAN = 1 << 20, (1 << 20) + 1, (1 << 20) + 2


def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, bin, part)``: integers whose sum of part 2^(WIDTH bin - BASE) by place is each number of ``x``."""
    finite = np.isfinite(x)
    mantissa, exponent = np.frexp(np.where(finite, x, 0.0))
    whole = np.ldexp(mantissa, 53).astype(np.int64)
    # the least bit of subnormal numbers is -1074, so what a shift takes from them is zeros
    shift = exponent.astype(np.int64) - 53 + BASE
    low = np.maximum(shift, 0)
    whole = whole >> (low - shift)
    at, inside = low // WIDTH, low % WIDTH
    sign, whole = np.sign(whole), np.abs(whole).astype(np.uint64)
    mask = np.uint64((1 << WIDTH) - 1)
    first = (whole & (mask >> inside.astype(np.uint64))) << inside.astype(np.uint64)
    rest = whole >> (np.uint64(WIDTH) - inside.astype(np.uint64))
    pieces = [first, rest & mask, rest >> np.uint64(WIDTH)]
    place = np.arange(len(x))
    out = [(place, at + k, sign * p.astype(np.int64)) for k, p in enumerate(pieces)]
    for bin_, hit in ((PLUS, x == np.inf), (MINUS, x == -np.inf), (NAN, np.isnan(x))):
        out.append((place[hit], np.full(hit.sum(), bin_), np.ones(hit.sum(), np.int64)))
    places, bins, values = (np.concatenate(c) for c in zip(*out))
    return places[values != 0], bins[values != 0], values[values != 0]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice as many numbers whose exact sum is that of the products: rounded ones and their errors (Dekker and Veltkamp).

    Exact for factors between 2^-450 and 2^450 in size, and for zeros.
    """
    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = 134217729.0 * a
        high = high - (high - a)
        return high, a - high

    with np.errstate(invalid="ignore", over="ignore"):
        p = x * y
        (a, b), (c, d) = split(x), split(y)
        error = b * d - (((p - a * c) - b * c) - a * d)
    return np.concatenate([p, np.where(np.isfinite(p), error, 0.0)])


def total(bins: dict[int, int]) -> float:
    """The double nearest to what bins add up to."""
    if bins.get(NAN) or bins.get(PLUS) and bins.get(MINUS):
        return float("nan")
    if bins.get(PLUS) or bins.get(MINUS):
        return float("inf") if bins.get(PLUS) else float("-inf")
    whole = sum(int(v) << (WIDTH * int(b)) for b, v in bins.items())
    try:
        return float(Fraction(whole, 1 << BASE))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def exact_sum(df: DataFrame, by: list[str], value: str, factor: str | None = None, name: str = "v") -> DataFrame:
    """``(*by, name)``: each group's sum of ``value``, or of its products with ``factor``, rounded once.

    Nulls are left out; a group of nothing else, and with no ``by`` an empty table, has 0.0. Infinities and NaN
    count as in any sum. Null keys are a group.
    """
    columns = [F.col(value).cast("double").alias("_x"), *([F.col(factor).cast("double").alias("_y")] if factor else [])]
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), *columns)
    kind = rows.schema["g"].dataType.simpleString()

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) if k < batch.num_columns else None for k in (1, 2))
            there = np.array(batch.column(1).is_valid()) & (np.array(batch.column(2).is_valid()) if factor else True)
            rows_ = np.flatnonzero(there)
            numbers = products(x[there], y[there]) if factor else x[there]
            place, bins, values = parts(numbers.astype(float))
            place = rows_[place % max(1, len(rows_))] if len(rows_) else place
            if not by and len(place):
                # one group: what a batch has is summed here
                bins, where = np.unique(bins, return_inverse=True)
                sums = np.zeros(len(bins), np.int64)
                np.add.at(sums, where, values)
                place, values = np.zeros(len(bins), np.int64), sums
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(bins, pa.int32()), pa.array(values, pa.int64())], ["g", "bin", "part"])

    sums = rows.mapInArrow(binned, f"g {kind}, bin int, part long").groupBy("g", "bin").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    entries = sums.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("s").cast("string").alias("s")))).alias("m"))

    @F.pandas_udf("string")
    def rounded(maps: pd.Series) -> pd.Series:
        # as text, as NaN would come out as null; a double's shortest text is read back as that double
        return pd.Series([repr(total({int(b): int(s) for b, s in dict(m).items()})) if m is not None else "0.0" for m in maps], dtype=object)

    groups = rows.select("g").distinct() if by else df.sparkSession.range(1).select(F.struct(F.lit(0).alias("_")).alias("g"))
    met = groups.alias("a").join(entries.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")), "left")
    return met.select(*(F.col(f"a.g.{c}").alias(c) for c in by), rounded(F.col("b.m")).cast("double").alias(name))


def exact_dot(x: DataFrame, y: DataFrame, init: float = 0.0) -> DataFrame:
    """``init`` plus the inner product of ``(i, v)`` vectors as one row ``v``, rounded once."""
    joined = x.join(y.select("i", F.col("v").alias("w")), "i").select("v", "w")
    start = x.sparkSession.range(1).select(F.lit(float(init)).alias("v"), F.lit(1.0).alias("w"))
    return exact_sum(joined.unionByName(start), [], "v", "w")
