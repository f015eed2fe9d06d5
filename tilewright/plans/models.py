"""Cost models: execution lookups, transfer times, predictors of overlap.

Tables: ``lookup`` is ``(T, sec, w)`` of one routine and device; ``problems`` have
``pid, D1, D2, D3, T`` and per-operand arrays. Lookups hold tens of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def nearest(wanted: DataFrame, lookup: DataFrame, on: list[str] | None = None, tile: str = "T_in") -> DataFrame:
    """As-of join: each row of ``wanted`` with the largest benchmarked T not over ``tile``.

    The smallest T where ``tile`` is below all. ``on`` are further equal keys. ``T_near``,
    ``sec_near`` and ``w_near`` are added. The lookup is folded to one sorted array a
    key, so a row of ``wanted`` is joined once, not once a tile.
    """
    on = on or []
    arrays = lookup.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("T", "sec", "w"))).alias("_l"))
    # without keys it is one row; with keys Spark broadcasts it if its size allows
    joined = wanted.join(arrays, on) if on else wanted.join(F.broadcast(arrays))
    below = F.filter("_l", lambda x: x["T"] <= F.col(tile))
    hit = F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.element_at("_l", 1))
    return joined.withColumn("_h", hit).select(*wanted.columns, F.col("_h.T").alias("T_near"), F.col("_h.sec").alias("sec_near"), F.col("_h.w").alias("w_near"))


def rescaled(sec_near: Column, tile: Column, t_tile: Column, level: int = 3, compat: bool = True) -> Column:
    """Time of a tile from that of the nearest: by the cube of the ratio.

    ``compat`` keeps the cube at levels 1 and 2; without it their own power is used.
    """
    return sec_near * F.pow(tile / t_tile, F.lit(3.0 if compat else float(level)))


def transfer(ti: Column, tb: Column, size: Column) -> Column:
    """Seconds for ``size`` bytes: -1 below zero, 0 for none, else latency and bytes."""
    return F.when(size < 0, F.lit(-1.0)).when(size == 0, F.lit(0.0)).otherwise(ti + tb * size)


def shared_transfer(src: Column, dest: Column, ti: Column, bw: Column, partner_bw: Column, size: Column) -> Column:
    """Over a shared link: the partner's bandwidth where its own is -1; 0 to itself."""
    own = F.when(bw == -1, partner_bw).otherwise(bw)
    return F.when(src == dest, F.lit(0.0)).otherwise(ti + size / (F.lit(1e9) * own))


def slowed_transfer(ti: Column, tb: Column, size: Column, sl: Column) -> Column:
    return ti + tb * size * sl


def both_ways(ti_x: Column, tb_x: Column, b_x: Column, sl_x: Column, ti_y: Column, tb_y: Column, b_y: Column, sl_y: Column) -> Column:
    """Two opposed transfers: the shorter slowed one overlaps, the rest of the other is at full speed."""
    x, y = ti_x + tb_x * b_x * sl_x, ti_y + tb_y * b_y * sl_y
    rest = lambda short, sl, b, tb, ti: short * (1 - 1 / sl) + b * tb + ti / sl
    return F.when(x <= y, rest(x, sl_y, b_y, tb_y, ti_y)).otherwise(rest(y, sl_x, b_x, tb_x, ti_x))


def full_time(t_tile: Column, tile: Column, *dims: Column) -> Column:
    """The whole problem from one tile: its number of tiles, in fractions."""
    out = t_tile
    for d in dims:
        out = out * d / tile
    return out


def model_tile(max_t: Column, *dims: Column) -> Column:
    """Tile that the whole-problem time is taken from, before the as-of lookup."""
    return F.least(max_t, *dims)


def full_overlap(full: Column, receive: Column, send: Column) -> Column:
    return F.greatest(full, receive, send)


def zero_overlap(full: Column, receive: Column, send: Column) -> Column:
    return full + receive + send


def task_count(tile: Column, *dims: Column) -> Column:
    out = F.lit(1).cast("long")
    for d in dims:
        out = out * F.ceil(d / tile).cast("long")
    return out


def reuse(t: Column, r: Column, s: Column, nin: Column, nout: Column, zero: Column, one: Column, two: Column) -> Column:
    """Tasks by how many operands they still fetch (0, 1, 2)."""
    return t * (1 + zero) + F.greatest(t, r) * one + F.greatest(t, 2 * r) * two + nin * r + nout * s


def sum_bandwidth_time(size: Column, bandwidths: Column, hop_penalty: float = 0.2) -> Column:
    """Seconds over all peers' links at once, their sum less by ``hop_penalty`` once for each peer; 0 without peers."""
    total = F.aggregate(bandwidths, F.lit(0.0), lambda a, b: a + b) * F.pow(F.lit(1 - hop_penalty), F.size(bandwidths))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(size, total * 1e9))


def mean_bandwidth_time(size: Column, links: Column) -> Column:
    """Seconds for equal parts, whole bytes each, one peer after the other; ``links`` are the peers' ``(ti, bw)``. 0 without peers."""
    part = F.floor(F.try_divide(size, F.size(links)))
    return F.coalesce(F.aggregate(links, F.lit(0.0), lambda t, x: t + x["ti"] + part / (1e9 * x["bw"])), F.lit(0.0))


def allowed_tiles(level: int, min_t: Column, *dims: Column) -> tuple[Column, Column]:
    """Least and greatest tile that a problem may use."""
    return (min_t if level == 1 else F.greatest(min_t, F.lit(1024))), F.least(*dims) if len(dims) > 1 else dims[0]


def stream_bytes(policy: str, sizes: Column, remote: Column, tile_bytes: Column) -> Column:
    """Bytes that the streams model counts: ``all`` operands, only ``remote`` ones, or all in whole ``tile`` s of ``tile_bytes``."""
    add = lambda a, x: a + x
    if policy == "all":
        return F.aggregate(sizes, F.lit(0).cast("long"), add)
    if policy == "remote":
        return F.aggregate(F.zip_with(sizes, remote, lambda s, f: F.when(f, s).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), add)
    if policy == "tile":
        return F.aggregate(F.transform(sizes, lambda s: F.ceil(s / tile_bytes).cast("long") * tile_bytes), F.lit(0).cast("long"), add)
    raise ValueError(f"there is no byte policy {policy!r}")
