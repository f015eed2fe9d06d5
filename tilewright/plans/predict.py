"""Predicted times of a routine on a unit, from where its operands lie, a lookup of tile times and the link model.

:func:`prepared` puts on each row of ``problems`` (``pid, unit, D1, D2, D3, T, loc_a, loc_b, loc_c``; -1 is the
host) the time ``tile_t`` of one tile, ``full_t`` of the whole problem, and the links as maps. The predictors are
columns over such a row. Operands are received over the link to the unit and sent over the link from it;
``reverse`` takes the opposite ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans import models as cm

#: Extra time for each dimension that the tile doesn't divide, and for tasks that don't divide among units.
RAGGED, UNEVEN = 0.05, 0.1


class Operand(NamedTuple):
    loc: str
    dims: tuple[str, ...]
    read: bool = True
    written: bool = False


ROUTINES = {
    "gemm": (Operand("loc_a", ("D1", "D3")), Operand("loc_b", ("D3", "D2")), Operand("loc_c", ("D1", "D2"), written=True)),
    "gemv": (Operand("loc_a", ("D1", "D2")), Operand("loc_b", ("D2",)), Operand("loc_c", ("D1",), written=True)),
    "axpy": (Operand("loc_a", ("D1",)), Operand("loc_b", ("D1",), written=True)),
    "dot": (Operand("loc_a", ("D1",)), Operand("loc_b", ("D1",))),
}
LEVELS = {"gemm": 3, "gemv": 2, "axpy": 1, "dot": 1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(dest: Column, src: Column) -> Column:
    return ((dest + 2) * 1000 + src + 2).cast("int")


def linked(df: DataFrame, links: DataFrame) -> DataFrame:
    """``df`` with a map ``_<name>`` by link for each column of ``links`` but its ends. Links are units squared: one row of maps."""
    key = _key(F.col("dest"), F.col("src"))
    maps = [F.map_from_entries(F.collect_list(F.struct(key, c))).alias(f"_{c}") for c in links.columns if c not in ("dest", "src")]
    return df.crossJoin(F.broadcast(links.agg(*maps)))


def of_link(name: str, dest: Column, src: Column) -> Column:
    return F.element_at(F.col(f"_{name}"), _key(dest, src))


def transfer(dest: Column, src: Column, size: Column) -> Column:
    return cm.transfer(of_link("ti", dest, src), of_link("tb", dest, src), size)


def prepared(problems: DataFrame, lookup: DataFrame, links: DataFrame, level: int = 3, compat: bool = True) -> DataFrame:
    """Adds ``tile_t`` and ``full_t`` from the unit's lookup ``(unit, T, sec, w)``, and the links' maps.

    ``compat`` scales lower levels by the cube, and takes the whole time of level 1 from the smallest
    benchmarked tile; without it their own power and the largest that fits.
    """
    dims = [F.col(f"D{k}") for k in range(1, level + 1)]
    ends = lookup.groupBy("unit").agg(F.min("T").alias("_min"), F.max("T").alias("_max"))
    near = cm.nearest(problems, lookup, ["unit"], "T").withColumn("tile_t", cm.rescaled(F.col("sec_near"), F.col("T"), F.col("T_near"), level, compat)).drop("T_near", "sec_near", "w_near")
    near = near.join(ends, "unit")
    big = F.least("_min", "_max") if level == 1 and compat else cm.model_tile(F.col("_max"), *dims)
    full = cm.nearest(near.withColumn("_tb", big), lookup, ["unit"], "_tb")
    full = full.withColumn("full_t", cm.full_time(F.col("sec_near"), F.col("T_near"), *dims)).drop("T_near", "sec_near", "w_near", "_tb", "_min", "_max")
    return linked(full, links)


def size_of(operand: Operand, width: int = 8) -> Column:
    out = F.lit(width).cast("long")
    for d in operand.dims:
        out = out * F.col(d)
    return out


def _sum(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for x in terms:
        out = out + x
    return out


def receive_and_send(routine: str, reverse: bool = False) -> tuple[Column, Column]:
    """Seconds that all operands' whole transfers take one after the other, in and out."""
    unit, ops = F.col("unit"), ROUTINES[routine]
    came = lambda o: transfer(F.col(o.loc), unit, size_of(o)) if reverse else transfer(unit, F.col(o.loc), size_of(o))
    went = lambda o: transfer(F.col(o.loc), unit, size_of(o))
    return _sum([came(o) for o in ops if o.read]), _sum([went(o) for o in ops if o.written])


def overlap(routine: str, whole: bool = True) -> Column:
    """Whole-problem time if compute and transfers overlap fully, or not at all."""
    came, went = receive_and_send(routine)
    return (cm.full_overlap if whole else cm.zero_overlap)(F.col("full_t"), came, went)


def main_location(routine: str, units: list[int], size: Column) -> Column:
    """Where most operands lie; ties go to the slower receive, then to the host, then to the lowest unit."""
    ops = ROUTINES[routine]
    each = []
    for place, u in enumerate([-1, *sorted(x for x in units if x >= 0)]):
        count = F.lit(0)
        for o in ops:
            count = count + (F.col(o.loc) == u).cast("int")
        each.append(F.struct(count.alias("n"), transfer(F.col("unit"), F.lit(u), size).alias("r"), F.lit(-place).alias("p"), F.lit(u).alias("loc")))
    return F.greatest(*each)["loc"]


def with_tile_transfers(df: DataFrame, routine: str, units: list[int]) -> DataFrame:
    """Adds ``mv``, :func:`main_location`, and ``r`` and ``s``, the times of one tile from there and to it.

    A tile is a square of T at level 3, a run of T at the lower levels.
    """
    t = F.col("T").cast("long")
    size = 8 * t * t if LEVELS[routine] == 3 else 8 * t
    df = df.withColumn("mv", main_location(routine, units, size))
    return df.withColumn("r", transfer(F.col("unit"), F.col("mv"), size)).withColumn("s", transfer(F.col("mv"), F.col("unit"), size)).withColumn("tile_bytes", size)


def _counts(routine: str, far: bool) -> tuple[Column, Column]:
    one = lambda o: (F.col(o.loc) != F.col("unit")).cast("int") if far else F.lit(1)
    ops = ROUTINES[routine]
    total = lambda xs: sum(xs, F.lit(0))
    return total([one(o) for o in ops if o.read]), total([one(o) for o in ops if o.written])


def tiles(routine: str) -> Column:
    """How many tiles of work there are, in fractions."""
    out = F.lit(1.0)
    for k in range(1, LEVELS[routine] + 1 if LEVELS[routine] == 3 else 2):
        out = out * F.col(f"D{k}") / F.col("T")
    return out


def steady(routine: str, far: bool) -> Column:
    """All operands fetched and sent for every task, or (``far``) those that lie elsewhere only."""
    nin, nout = _counts(routine, far)
    return let(F.struct(F.col("tile_t").alias("t"), (nin * F.col("r")).alias("i"), (nout * F.col("s")).alias("o"), tiles(routine).alias("v")), lambda x: F.greatest(x["t"], x["i"], x["o"]) * (x["v"] - 1) + x["t"] + x["i"] + x["o"])


def opposed(b_in: Column, b_out: Column) -> Column:
    """Both directions between the unit and ``mv`` at once; one of them if the other has nothing to move."""
    unit, mv = F.col("unit"), F.col("mv")
    to, back = lambda n: of_link(n, unit, mv), lambda n: of_link(n, mv, unit)
    both = cm.both_ways(to("ti"), to("tb"), b_in, to("sl"), back("ti"), back("tb"), b_out, back("sl"))
    return F.when(b_in == 0, transfer(mv, unit, b_out)).when(b_out == 0, transfer(unit, mv, b_in)).otherwise(both)


def bidirectional(routine: str) -> Column:
    """As :func:`steady` of far operands, with the two directions slowing each other. At the lower levels the last
    task ends with its result's transfer, if that is longer, and tasks are counted along the first dimension."""
    nin, nout = _counts(routine, True)
    over = opposed(F.col("tile_bytes") * nin, F.col("tile_bytes") * nout)
    values = F.struct(F.col("tile_t").alias("t"), over.alias("over"), (nin * F.col("r")).alias("i"), (nout * F.col("s")).alias("o"), tiles(routine).alias("v"))
    last = (lambda x: x["t"]) if LEVELS[routine] == 3 else (lambda x: F.greatest(x["t"], x["o"]))
    return let(values, lambda x: F.greatest(x["t"], x["over"]) * (x["v"] - 1) + last(x) + x["i"] + x["o"])


def reuse() -> Column:
    """gemm whose tiles stay where they came: tasks that fetch no, one or two operands first.

    One tile each of the far operands is fetched by some task (``one``). Where a fetch is longer than
    a task, two far operands that share a dimension also meet new along it (``two``); where two
    fetches are longer, those along the inner dimension count as such.
    """
    a, b, c = (F.col(o.loc) != F.col("unit") for o in ROUTINES["gemm"])
    ratio = lambda d: F.col(d) / F.col("T")
    t, r = F.col("tile_t"), F.col("r")
    nin = a.cast("int") + b.cast("int") + c.cast("int")
    fetched = F.when(a, ratio("D1") * ratio("D3")).otherwise(0.0) + F.when(b, ratio("D3") * ratio("D2")).otherwise(0.0) + F.when(c, ratio("D1") * ratio("D2")).otherwise(0.0)
    met = F.when(a & b, ratio("D3") - 1).otherwise(0.0) + F.when(a & c, ratio("D1") - 1).otherwise(0.0) + F.when(b & c, ratio("D2") - 1).otherwise(0.0)
    two = F.when(r > t, met).otherwise(0.0) + F.when((2 * r > t) & (t > r), ratio("D3")).otherwise(0.0)

    def total(x: Column) -> Column:
        one = x["f"] - (2 * x["two"] + x["nin"])
        zero = x["v"] - 1 - (one + x["two"])
        return cm.reuse(x["t"], x["r"], x["s"], x["nin"], x["nout"], zero, one, x["two"])

    return let(F.struct(t.alias("t"), r.alias("r"), F.col("s").alias("s"), nin.alias("nin"), c.cast("int").alias("nout"), fetched.alias("f"), two.alias("two"), tiles("gemm").alias("v")), total)


def on_share(value: Column, share: Column, units: Column, level: int) -> Column:
    """A unit's share of a time, longer where tiles are ragged and, at level 3, where tasks don't divide among ``units``."""
    ragged = F.lit(1.0)
    for k in range(1, level + 1 if level == 3 else 2):
        ragged = ragged + F.when(F.col(f"D{k}") % F.col("T") != 0, RAGGED).otherwise(0.0)
    if level != 3:
        return value * ragged * share
    uneven = cm.task_count(F.col("T"), F.col("D1"), F.col("D2"), F.col("D3")) % units != 0
    return value * ragged * F.when(uneven, 1 + UNEVEN).otherwise(1.0) * share


def pipeline() -> Column:
    """gemm's tasks one after the other: each waits for its operands' first touch, fetched from the host in turn.

    A last tile of more than half an edge is one of its own, a smaller one is added to the one before;
    such tiles' times are in proportion. Results but the last one's go out unseen. Needs T up to the least dimension.
    """
    t, host = F.col("T"), F.lit(-1)
    size = 8 * t.cast("long") * t
    cut = lambda d: F.col(d) % t
    own = lambda d: cut(d) > F.floor(t / 2)
    parts = lambda d: F.floor(F.col(d) / t) + F.when(own(d), 1).otherwise(0)
    last = lambda d: F.when(own(d), cut(d)).otherwise(cut(d) + t) / t
    far = lambda loc: (F.col(loc) != F.col("unit")).cast("int")
    values = F.struct(
        *(parts(f"D{k}").cast("long").alias(f"g{k}") for k in (1, 2, 3)), *(last(f"D{k}").alias(f"l{k}") for k in (1, 2, 3)), F.col("tile_t").alias("t"),
        transfer(F.col("unit"), host, size).alias("r"), (transfer(host, F.col("unit"), size) * far("loc_c")).alias("s"), *(far(f"loc_{x}").alias(x) for x in "abc"))

    def run(x: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("work"), F.lit(0.0).alias("link"), F.lit(0.0).alias("adj"))

        def step(state: Column, sk: Column) -> Column:
            mi, ni, ki = F.floor(sk / (x["g2"] * x["g3"])), F.floor(sk / x["g3"]) % x["g2"], sk % x["g3"]
            e1, e2, e3 = (F.when(i == x[f"g{k}"] - 1, x[f"l{k}"]).otherwise(1.0) for k, i in ((1, mi), (2, ni), (3, ki)))
            fetch = F.when(ni == 0, x["a"] * e1 * e3).otherwise(0.0) + F.when(mi == 0, x["b"] * e2 * e3).otherwise(0.0) + F.when(ki == 0, x["c"] * e1 * e2).otherwise(0.0)
            return F.struct(
                F.when(sk == 0, 0.0).otherwise(F.greatest(state["link"], state["work"]) + state["adj"]).alias("work"),
                (state["link"] + fetch * x["r"]).alias("link"), (x["t"] * e1 * e2 * e3).alias("adj"))

        steps = F.sequence(F.lit(0).cast("long"), x["g1"] * x["g2"] * x["g3"] - 1)
        return F.aggregate(steps, start, step, lambda z: F.greatest(z["work"], z["link"]) + z["adj"] + x["l1"] * x["l2"] * x["s"])

    return let(values, run)


def streams(policy: str) -> Column:
    """gemm in as many streams as there are tiles, with the host: the largest of three dominances.

    Bytes by ``policy``: ``all`` operands; ``far`` ones only; ``tile``: far ones, with the time of the work from one tile.
    """
    far = lambda o: F.lit(1) if policy == "all" else (F.col(o.loc) != F.col("unit")).cast("int")
    ops, host, unit = ROUTINES["gemm"], F.lit(-1), F.col("unit")
    b_in, b_out = sum((far(o) * size_of(o) for o in ops), F.lit(0)), far(ops[2]) * size_of(ops[2])
    values = F.struct(
        tiles("gemm").alias("n"), (F.col("tile_t") * tiles("gemm") if policy == "tile" else F.col("full_t")).alias("k"), b_in.alias("bi"), b_out.alias("bo"),
        of_link("ti", unit, host).alias("ti"), of_link("tb", unit, host).alias("tb"), of_link("ti", host, unit).alias("ui"), of_link("tb", host, unit).alias("ub"))

    def total(x: Column) -> Column:
        n = x["n"]
        in_all, in_one = x["ti"] * n + x["tb"] * x["bi"], x["ti"] + x["tb"] * x["bi"] / n
        out_all, out_one = x["ui"] * n + x["ub"] * x["bo"], x["ui"] + x["ub"] * x["bo"] / n
        return F.greatest(in_all + x["k"] / n + out_one, in_one + x["k"] + out_one, in_one + x["k"] / n + out_all)

    return let(values, total)


def hetero_overlap(score: Column) -> tuple[Column, Column, Column]:
    """A unit's share of gemm: its compute time, and receives and sends over links that others share.

    Needs the maps of :func:`tilewright.plans.links.shared_links`: ``_bw`` and ``_share``, 2 where the partner link is in use.
    """
    unit = F.col("unit")

    def moved(dest: Column, src: Column, o: Operand) -> Column:
        size = F.floor(size_of(o) * score)
        seconds = of_link("ti", dest, src) + size / (F.lit(1e9) * of_link("bw", dest, src))
        return F.when((size == 0) | (dest == src), F.lit(0.0)).otherwise(of_link("share", dest, src) * seconds)

    ops = ROUTINES["gemm"]
    came = _sum([moved(unit, F.col(o.loc), o) for o in ops if o.read])
    return score * F.col("full_t"), came, _sum([moved(F.col(o.loc), unit, o) for o in ops if o.written])
