"""Tile choice, device subsets, splits and task distribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tiles under TILE_MIN and over TILE_MAX cost extra, and so do more than MAX_TASKS tasks a unit.
TILE_MIN, TILE_MIN_COST, TILE_MAX, TILE_MAX_COST, MAX_TASKS, MAX_TASKS_COST = 2048, 0.2, 4096, 0.1, 512, 0.1


def tile_terms(tile: Column, d1: Column, d2: Column, d3: Column, units: Column) -> dict[str, Column]:
    """The five penalties of a tile size: imbalance, remainder, small, count, big. A d2 or d3 of -1 is as d1."""
    d2, d3 = F.when(d2 == -1, d1).otherwise(d2), F.when(d3 == -1, d1).otherwise(d3)
    up = lambda d: F.ceil(d / tile).cast("long")
    div = lambda a, b: F.floor(a / b)
    tasks = up(d1) * up(d2) * up(d3)
    blocks = up(d1) * up(d2)
    turns = div(blocks, units)
    imbalance = F.when(turns > 0, (blocks % units) / turns * units).otherwise(blocks / units)
    remainder = sum((F.when(d % tile != 0, 1.0 / F.greatest(div(d, tile), F.lit(1))).otherwise(0.0) for d in (d1, d2, d3)), F.lit(0.0))
    small = F.when(tile < TILE_MIN, F.lit(float(TILE_MIN)) / tile * TILE_MIN_COST).otherwise(0.0)
    k = div(tasks, units)
    count = F.when(k == 0, F.lit(float("inf"))).otherwise(2.0 / F.greatest(k, F.lit(1)) + F.when(k > MAX_TASKS, k / float(MAX_TASKS) * MAX_TASKS_COST).otherwise(0.0))
    big = F.when(tile > TILE_MAX, div(tile, F.lit(TILE_MAX)) * TILE_MAX_COST).otherwise(0.0)
    return {"imbalance": imbalance, "remainder": remainder, "small": small, "count": count, "big": big}


def tile_slowdown(tile: Column, d1: Column, d2: Column, d3: Column, units: Column) -> Column:
    """Sum of :func:`tile_terms`."""
    a, b, c, d, e = tile_terms(tile, d1, d2, d3, units).values()
    return a + b + c + d + e


def _runs(d: Column) -> Column:
    """The tile sizes at which the number of tiles along ``d``, whole ones or all, is about to change: O(sqrt d) of them."""
    root = F.ceil(F.sqrt(d)).cast("long")
    q = F.sequence(F.lit(1).cast("long"), F.greatest(root, F.lit(1).cast("long")))
    div = lambda a, k: F.floor(a / k).cast("long")
    return F.concat(q, F.transform(q, lambda k: div(d, k)), F.transform(q, lambda k: div(d - 1, k)))


def candidate_tiles(d1: Column, d2: Column, d3: Column) -> Column:
    """Tile sizes among which the least slowdown is, and the largest that has it.

    Between two of :func:`_runs` the numbers of tiles are constant and no size divides a dimension but
    the last one; there the small-tile penalty falls and the big-tile one rises at multiples of TILE_MAX only. So
    the last size of each stretch is as good as any in it.
    """
    top = F.least(d1, d2, d3)
    steps = F.transform(F.sequence(F.lit(1).cast("long"), F.floor(top / TILE_MAX).cast("long") + 1), lambda k: F.when(k == 1, F.lit(TILE_MAX)).otherwise(k * TILE_MAX - 1))
    all_ = F.concat(F.array(top), steps, _runs(d1), _runs(d2), _runs(d3))
    return F.array_distinct(F.filter(all_, lambda t: (t >= 1) & (t <= top)))


def best_tile(problems: DataFrame, digits: int = 9) -> DataFrame:
    """``(pid, T, slowdown)`` of least slowdown over all T up to the least dimension; ties keep the larger.

    ``problems``: ``(pid, D1, D2, D3, units)``. Slowdowns are compared to ``digits`` places.
    """
    d1 = F.col("D1")
    d2, d3 = (F.when(F.col(d) == -1, d1).otherwise(F.col(d)) for d in ("D2", "D3"))
    each = problems.select("*", F.explode(candidate_tiles(d1, d2, d3)).alias("T"))
    sl = F.round(tile_slowdown(F.col("T"), d1, d2, d3, F.col("units")), digits)
    return each.withColumn("sl", sl).groupBy("pid").agg(F.min(F.struct("sl", (-F.col("T")).alias("neg"))).alias("m")).select("pid", (-F.col("m.neg")).alias("T"), F.col("m.sl").alias("slowdown"))


def best_benchmarked_tile(predictions: DataFrame, digits: int = 12) -> DataFrame:
    """``(pid, T, sec)`` of least predicted time over the benchmarked tiles that a problem allows; of equal ones the first, that is the smallest.

    A prediction below zero has failed and isn't taken. Times are equal if they are so to ``digits`` places.
    """
    m = predictions.where("sec >= 0").groupBy("pid").agg(first_of_best("sec", digits).alias("m"))
    return m.select("pid", "m.T", "m.sec")


def first_of_best(sec: str, digits: int = 12) -> Column:
    """An aggregate ``(sec, T)``: the least of the times in column ``sec`` that aren't below zero, to ``digits`` places, and the smallest T that has it."""
    return F.min(F.when(F.col(sec) >= 0, F.struct(F.round(sec, digits).alias("sec"), "T")))


def device_subsets(spark, units: int, most: int | None = None) -> DataFrame:
    """``(case, units)``: every non-empty subset, as the bits of its number."""
    cases = spark.range(1, 1 << units).select(F.col("id").alias("case"))
    has = lambda k: F.floor(F.col("case") / F.pow(F.lit(2.0), k)) % 2 == 1
    listed = cases.select("case", F.filter(F.sequence(F.lit(0), F.lit(units - 1)), has).alias("units"))
    return listed.where(F.size("units") <= most) if most else listed


def permutations(spark, units: int) -> DataFrame:
    """``(place, units)``: all orders of 0 to ``units`` - 1, in lexicographic order; 8 units at most."""
    if units > 8:
        raise ValueError("orders of more than 8 units aren't listed")
    out = spark.range(1).select(F.array().cast("array<int>").alias("units"))
    for _ in range(units):
        rest = F.array_except(F.sequence(F.lit(0), F.lit(units - 1)), F.col("units"))
        out = out.select(F.col("units").alias("u"), F.explode(rest).alias("n")).select(F.concat("u", F.array("n")).alias("units"))
    return out.select((F.row_number().over(W.orderBy("units")) - 1).alias("place"), "units")


def normalised_split(scores: Column, least: float = 0.05, tolerance: float = 0.05) -> Column:
    """Scores under ``least`` dropped to 0, the others rescaled; scores near each other averaged.

    One place after the other: a score under ``least`` goes, and the rest is divided by what is left; any
    other is averaged with the later ones nearer to it than ``tolerance`` times the number of units.
    """
    n = F.size(scores)
    doubles = F.transform(scores, lambda x: x.cast("double"))

    def step(v: Column, i: Column) -> Column:
        own = F.element_at(v, i)
        rest = F.transform(v, lambda x, k: F.when(k + 1 == i, F.lit(0.0)).otherwise(F.try_divide(x, 1 - own)))
        joins = lambda x, k: (k + 1 == i) | ((k + 1 > i) & (F.abs(x - own) < tolerance * n * own))
        picked = F.filter(v, joins)
        mean = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.size(picked)
        return F.when(own < least, rest).otherwise(F.transform(v, lambda x, k: F.when(joins(x, k), mean).otherwise(x)))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), doubles, step)).otherwise(doubles)


def quotas(scores: DataFrame) -> DataFrame:
    """``(pid, unit, quota)``: the whole part of score * n, then one more in order of the units until n are given.

    ``scores``: ``(pid, unit, score, n)``. Scores are taken to 9 places, so that 0.1 * 30 is 3.
    """
    base = F.floor(F.round(F.col("score") * F.col("n"), 9)).cast("long")
    df = scores.withColumn("base", base)
    left = F.col("n") - F.sum("base").over(W.partitionBy("pid"))
    place = F.row_number().over(W.partitionBy("pid").orderBy("unit"))
    count = F.count("*").over(W.partitionBy("pid"))
    extra = F.floor(left / count) + F.when(place <= left % count, 1).otherwise(0)
    return df.select("pid", "unit", (F.col("base") + extra).cast("long").alias("quota"))


def distribute(quota: DataFrame, strategy: str, chunk: int = 1) -> DataFrame:
    """``(pid, sk, unit)``: tasks to units by their quotas.

    ``round_robin``: in turns; ``contiguous``: a run for each unit; ``chunked``: turns of
    ``chunk`` tasks at a time; ``chunked_reverse``: the same with the tasks of every second
    unit's chunks in reverse order. Idle units get none.
    """
    slots = quota.where("quota > 0").select("pid", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("slot"))
    if strategy == "round_robin":
        order = ["slot", "unit"]
    elif strategy == "contiguous":
        order = ["unit", "slot"]
    elif strategy == "chunked":
        order = [F.floor(F.col("slot") / chunk), "unit", "slot"]
    elif strategy == "chunked_reverse":
        within = F.col("slot") % chunk
        order = [F.floor(F.col("slot") / chunk), "unit", F.when(F.col("unit") % 2 == 0, -within).otherwise(within)]
    else:
        raise ValueError(f"there is no strategy {strategy!r}")
    return slots.select("pid", (F.row_number().over(W.partitionBy("pid").orderBy(*order)) - 1).cast("long").alias("sk"), "unit", "slot")


def squarest(units: int) -> tuple[int, int]:
    """The factors of a number that are nearest each other: the first is the greatest up to one more than its root."""
    p1 = next(k for k in range(int(units**0.5) + 1, 0, -1) if units % k == 0)
    return p1, units // p1


def block_quotas(scores: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets a unit may take: the whole part of its score, then one more for units below an even share, then one more in order."""
    quota = np.floor(np.round(scores * buckets, 9)).astype(int)
    for below in (quota < buckets // len(scores), np.ones(len(scores), bool)):
        left = buckets - quota.sum()
        quota[np.flatnonzero(below)[:max(left, 0)]] += 1
    while (left := buckets - quota.sum()) > 0:
        quota[:left] += 1
    return quota


def block_owners(g1: int, g2: int, g3: int, scores: list[float]) -> np.ndarray:
    """The unit of each (mi, ni) of a g1 x g2 x g3 grid, or of each (mi, ni, ki) if the grid is dealt task by task.

    Units are laid out p1 x p2; each has a block of the grid, and what is over its quota goes to the next unit that
    has room. Rows and columns beyond a multiple of p1 and p2 are dealt in turns: columns, rows, corner. A grid
    narrower than the layout is dealt row by row of D3, one of width 1 task by task, both in turns by quota.
    """
    n, share = len(scores), np.asarray(scores, float)
    p1, p2 = squarest(n)
    if g2 == 1 and g3 == 1:
        return _in_turns(share, g1).reshape(g1, 1)
    if g1 < p1 or g2 < p2:
        return _in_turns(share, g1 * g2).reshape(g1, g2)
    d1, d2 = g1 // p1 * p1, g2 // p2 * p2
    m, k = np.indices((d1, d2))
    owner = np.full((g1, g2), -1)
    inner = m // (g1 // p1) * p2 + k // (g2 // p2)
    quota = block_quotas(share, d1 * d2)
    if (np.bincount(inner.ravel(), minlength=n) > quota).any():
        room = quota.copy()
        for place, unit in enumerate(inner.ravel()):
            while room[unit] == 0:
                unit = (unit + 1) % n
            room[unit] -= 1
            inner.ravel()[place] = unit
    owner[:d1, :d2] = inner
    for part in (owner[:d1, d2:], owner[d1:, :d2], owner[d1:, d2:]):
        part[...] = (np.arange(part.size) % n).reshape(part.shape)
    return owner


def _in_turns(share: np.ndarray, count: int) -> np.ndarray:
    """``count`` things dealt one at a time to units by quota."""
    quota = np.floor(np.round(share * count, 9)).astype(int)
    left = count - quota.sum()
    quota += left // len(share) + (np.arange(len(share)) < left % len(share))
    unit = np.repeat(np.arange(len(share)), quota)
    slot = np.concatenate([np.arange(q) for q in quota])
    return unit[np.lexsort((unit, slot))]


def block_units(problems: DataFrame) -> DataFrame:
    """``(pid, mi, ni, unit)`` of ``(pid, g1, g2, g3, scores)``: every bucket of each grid with its unit; its g3 tasks go with it."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                owner = block_owners(p["g1"], p["g2"], p["g3"], p["scores"])
                mi, ni = np.indices(owner.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([p["pid"]] * owner.size, batch.schema.field("pid").type), pa.array(mi), pa.array(ni), pa.array(owner.ravel().astype(np.int32))], ["pid", "mi", "ni", "unit"])

    kind = dict(problems.dtypes)["pid"]
    return problems.select("pid", "g1", "g2", "g3", "scores").mapInArrow(dealt, f"pid {kind}, mi long, ni long, unit int")


def best_friends_seconds(links: DataFrame, ratio: float, size: Column) -> DataFrame:
    """``(dest, sec)``: ``size`` bytes from the fastest peers, each giving its :func:`closest_units` share of them, one after the other."""
    part = F.floor(F.col("share") / ratio * size)
    each = closest_units(links, ratio).join(links.select("dest", "src", "ti"), ["dest", "src"])
    return each.groupBy("dest").agg(F.sum(F.when(part > 0, F.col("ti") + part / (F.col("bw") * 1e9)).otherwise(0.0)).alias("sec"))


def closest_units(links: DataFrame, ratio: float) -> DataFrame:
    """Bandwidth-greedy share of each peer: the fastest take a unit of ``ratio`` each until it is spent."""
    place = F.row_number().over(W.partitionBy("dest").orderBy(F.desc("bw"), "src"))
    return links.select("dest", "src", "bw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio - (place - 1))).alias("share"))


def select_task(ready: DataFrame, rule: str = "eta") -> DataFrame:
    """``(unit, sk)``: each unit's next task.

    ``eta``: least fetch time, then most fired output tile, then number; ``local``: most
    tiles already there, then number; ``serial``: the first; ``cost``: least fetch cost with
    its penalties, then number.
    """
    order = {"eta": ["eta", F.desc("fired"), "sk"], "local": [F.desc("local_tiles"), "sk"], "serial": ["sk"], "cost": [F.col("eta") + F.col("penalty"), "sk"]}[rule]
    return ready.withColumn("_p", F.row_number().over(W.partitionBy("unit").orderBy(*order))).where("_p = 1").select("unit", "sk")


def warnings(tile: Column, d1: Column, d2: Column, d3: Column, units: Column, tasks: Column) -> Column:
    """``(name, slowdown)`` of the tuning conditions that a tile violates: C1 to C5 by :func:`tile_terms`.

    C4 counts only the cost of more than MAX_TASKS tasks a unit, by the exact ratio.
    """
    terms = tile_terms(tile, d1, d2, d3, units)
    many = F.when(F.floor(tasks / units) > MAX_TASKS, F.floor(tasks / units) / float(MAX_TASKS) * MAX_TASKS_COST).otherwise(0.0)
    each = (terms["imbalance"], terms["remainder"], terms["small"], many, terms["big"])
    return F.filter(F.array(*(F.struct(F.lit(f"C{k}").alias("name"), x.alias("slowdown")) for k, x in enumerate(each, 1))), lambda x: x["slowdown"] > 0)


def differing(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """In how many of its preset fields a plan ``b`` differs from ``a``: tile, units, cache limit.

    A field of ``b`` is preset unless it is null, -1 (tile), empty (units) or 0 (cache limit).
    """
    preset = {"T": b["T"] != -1, "units": F.size(b["units"]) > 0, "cache_limit": b["cache_limit"] != 0}
    one = lambda k: F.when(b[k].isNotNull() & preset[k] & ~a[k].eqNullSafe(b[k]), 1).otherwise(0)
    return one("T") + one("units") + one("cache_limit")


def plan_difference(a: dict, b: dict) -> int:
    """:func:`differing` of two plans at hand."""
    unset = {"T": (None, -1), "units": (None, [], ()), "cache_limit": (None, 0)}
    return sum(b.get(k) not in none and a.get(k) != b.get(k) for k, none in unset.items())
