"""Which units, which tile, which split: the search over device subsets.

Every problem is a row, and every subset of units a case with its own link map. A case's split is a fixed point
of a few rounds; the cases are then taken in order, each against the best so far: state that SQL operators
don't carry. So batches of problems go through NumPy, all problems of a batch at a time. Problems that are equal in
dimensions, locations and target are searched for once; the answers are joined to all of them. What the tasks get of cases and lookups is bounded by the number of units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans import tuner as tn
from tilewright.plans.links import shared_links
from tilewright.sources.paths import small_side, staged

TARGETS = ("PERF", "ENERGY", "POWER-DELAY", "ENERGY-DELAY", "PERF-PER-J")
#: Subsets of at most so many units are listed.
MOST_UNITS = 10
#: Rounds of the split, cost of a hop, what a further unit must bring, and when values are equal.
ROUNDS, HOP_COST, CONTRIBUTION, EQUAL = 10, 0.2, 0.05, 0.05


@dataclass(frozen=True)
class Case:
    """A subset of units; arrays are by unit, and by unit and place of a holder of data."""

    number: int
    p1: int
    p2: int
    units: np.ndarray
    tiles: list[tuple[np.ndarray, np.ndarray]]
    watts: np.ndarray
    came: np.ndarray
    went: np.ndarray
    row_bw: np.ndarray
    col_bw: np.ndarray

    @classmethod
    def of(cls, row) -> Case:
        table = lambda links: [[x.share * x.ti, np.nan if not x.bw else x.share / (x.bw * 1e9)] for x in links]
        of = lambda name: np.array([u[name] for u in row.u])
        tiles = [(np.array([t.T for t in u.tiles]), np.array([t.sec for t in u.tiles])) for u in row.u]
        return cls(row["case"], row.g.p1, row.g.p2, of("unit"), tiles, of("w"), np.array([table(u.came) for u in row.u]), np.array([table(u.went) for u in row.u]), of("row_bw"), of("col_bw"))

    def full(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Seconds of each whole problem on each unit."""
        out = []
        for sizes, sec in self.tiles:
            near = np.maximum(np.searchsorted(sizes, np.minimum.reduce([np.full_like(p["D1"], sizes[-1]), p["D1"], p["D2"], p["D3"]]), "right") - 1, 0)
            out.append(sec[near] * p["D1"] / sizes[near] * p["D2"] / sizes[near] * p["D3"] / sizes[near])
        return np.stack(out, 1)

    def times(self, p: dict[str, np.ndarray], full: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """``exec, recv, send, extra`` seconds of each problem on each unit, for its scores.

        ``extra``, the same for all units, is what the slowest one gets from those in its column and row
        for operands that it doesn't hold.
        """
        cells = {"a": p["D1"] * p["D3"], "b": p["D3"] * p["D2"], "c": p["D1"] * p["D2"]}
        size = {k: np.floor(8.0 * v[:, None] * scores) for k, v in cells.items()}
        away = {k: p[f"loc_{k}"][:, None] != self.units for k in "abc"}

        def moved(links: np.ndarray, k: str) -> np.ndarray:
            first, rate = np.moveaxis(links[:, p[f"loc_{k}"] + 1], 2, 0).transpose(0, 2, 1)
            return np.where(away[k] & (size[k] > 0), first + rate * size[k], 0.0)

        def extra(k: str, copies: int, bw: np.ndarray) -> np.ndarray:
            asked = np.floor(8.0 * cells[k][:, None] * scores * copies)
            return np.where(away[k] & (bw > 0), asked / np.where(bw > 0, bw * 1e9, 1.0), 0.0)

        peers = extra("a", self.p2 - 1, self.col_bw) + extra("b", self.p1 - 1, self.row_bw)
        came = moved(self.came, "a") + moved(self.came, "b") + moved(self.came, "c")
        return full * scores, came, moved(self.went, "c"), np.repeat(peers.max(1, keepdims=True), len(self.units), 1)


def cases(weights: DataFrame, lookup: DataFrame, units: int, most: int | None = None) -> list[Case]:
    """For each subset of units, in order of its number, what a split over it needs to know of each unit.

    ``u``: the unit, its lookup as an array, its watts, latency, bandwidth and share of the links from and to each
    holder of data (host first), and the summed bandwidth from the other units in its column and row of the layout.
    At most 2 to the number of units of them, so they are brought to the driver.
    """
    if units > MOST_UNITS:
        raise ValueError(f"subsets of more than {MOST_UNITS} units aren't listed")
    subsets = tn.device_subsets(weights.sparkSession, units, most)
    holders = F.array(*map(F.lit, range(-1, units)))
    links = shared_links(weights, subsets.select(F.col("case").alias("set"), F.col("units").alias("workers"), holders.alias("holders")))
    count = subsets.select("case", "units", F.size("units").alias("n"))
    layout = F.element_at(F.array(*(F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2")) for a, b in (tn.squarest(k) for k in range(1, units + 1)))), F.col("n"))
    placed = count.select("case", "n", layout.alias("g"), F.posexplode("units").alias("place", "unit"))
    far = F.struct((F.col("src") + 1).alias("from"), "ti", "bw", "share")
    went = F.struct((F.col("dest") + 1).alias("to"), "ti", "bw", "share")
    came = links.groupBy("set", F.col("dest").alias("unit")).agg(F.array_sort(F.collect_list(far)).alias("came"))
    out = links.groupBy("set", F.col("src").alias("unit")).agg(F.array_sort(F.collect_list(went)).alias("went"))
    at = lambda c: F.col(f"{c}.place")
    same = (F.col("a.case") == F.col("b.case")) & (F.col("a.place") != F.col("b.place"))
    row = F.floor(at("a") / F.col("a.g.p1")) == F.floor(at("b") / F.col("a.g.p1"))
    col = at("a") % F.col("a.g.p1") == at("b") % F.col("a.g.p1")
    pair = placed.alias("a").join(placed.alias("b"), same & (row | col))
    bw = links.select(F.col("set").alias("case"), F.col("dest").alias("unit"), F.col("src").alias("other"), F.col("bw").alias("pbw"))
    peers = pair.select("a.case", "a.unit", F.col("b.unit").alias("other"), row.alias("row"), col.alias("col")).join(bw, ["case", "unit", "other"])
    damped = lambda side: F.coalesce(F.sum(F.when(F.col(side), F.col("pbw"))) * F.pow(F.lit(1 - HOP_COST), F.count_if(side)), F.lit(0.0))
    sums = peers.groupBy("case", "unit").agg(damped("row").alias("row_bw"), damped("col").alias("col_bw"))
    tiles = lookup.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("T", "sec"))).alias("tiles"), F.max_by("w", "T").alias("w"))
    each = (
        placed.join(came.withColumnRenamed("set", "case"), ["case", "unit"]).join(out.withColumnRenamed("set", "case"), ["case", "unit"])
        .join(tiles, "unit").join(sums, ["case", "unit"], "left").fillna(0.0, ["row_bw", "col_bw"]))
    one = each.groupBy("case", "n", "g").agg(F.array_sort(F.collect_list(F.struct("place", "unit", "tiles", "w", "came", "went", "row_bw", "col_bw"))).alias("u"))
    return [Case.of(x) for x in one.orderBy("case").collect()]


def normalised(scores: np.ndarray) -> np.ndarray:
    """:func:`tilewright.plans.tuner.normalised_split` of each row."""
    v, n = scores.copy(), scores.shape[1]
    place = np.arange(n)
    for i in range(n):
        own = v[:, i:i + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(place == i, 0.0, v / (1 - own))
        joins = (place == i) | ((place > i) & (np.abs(v - own) < EQUAL * n * own))
        mean = (v * joins).sum(1, keepdims=True) / joins.sum(1, keepdims=True)
        v = np.where(own < CONTRIBUTION, rest, np.where(joins, mean, v))
    return v


def split(case: Case, p: dict[str, np.ndarray], tile_slowdown: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, even: bool = False) -> dict[str, np.ndarray]:
    """The split of each gemm over a case's units, and what it predicts: ``scores`` and ``t, j, pdp, edp`` with pessimistic ``pt, pj, ppdp, pedp``.

    Each round predicts with the scores as they are, then gives every unit its score over its objective (time, energy, or
    their inverse rates), rescaled and normalised; the predictions are the last round's. ``even`` keeps equal scores and
    stops after the first. A dropped unit has score 0.
    """
    flops = 2.0 * p["D1"] * p["D2"] * p["D3"]
    scores, full = np.full((len(flops), len(case.units)), 1.0 / len(case.units)), case.full(p)
    slower, kind = 1 + tile_slowdown[:, None], target[:, None]
    for _ in range(1 if even else rounds):
        parts = case.times(p, full, scores)
        sec, late = np.maximum.reduce(parts) * slower, sum(parts) * slower
        rate = np.floor(scores * flops[:, None]) / np.where(sec > 0, sec, np.nan)
        by = {"ENERGY": 1 / np.where(sec > 0, sec * case.watts, np.nan), "POWER-DELAY": rate / case.watts, "ENERGY-DELAY": rate**2 / case.watts}
        worth = scores * np.select([kind == k for k in by], list(by.values()), 1 / np.where(sec > 0, sec, np.nan))
        worth = np.where(scores == 0, 0.0, worth)
        predicted = sec.max(1), (sec * case.watts).sum(1), late.max(1), (late * case.watts).sum(1)
        if not even:
            scores = normalised(worth / worth.sum(1, keepdims=True))
    gf, (t, j, pt, pj) = flops / 1e9, predicted
    return {"scores": scores, "t": t, "j": j, "pdp": gf / j, "edp": (gf / t) ** 2 / (j / t), "pt": pt, "pj": pj, "ppdp": gf / pj, "pedp": (gf / pt) ** 2 / (pj / pt)}


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a < b * (1 - EQUAL)


def _more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a > b * (1 + EQUAL)


def accepts(x: dict[str, np.ndarray], best: dict[str, np.ndarray], target: np.ndarray, limit: float = 0.0) -> np.ndarray:
    """Whether a case takes the best one's place.

    Its value, worsened by 5 % for every unit that it has more (bettered for every one less), must be better by more
    than 5 %; or equal to 5 %, and its pessimistic value better so. ``PERF-PER-J`` weighs what is gained in
    time against what is lost in energy instead.
    """
    handicap = (x["n"] - best["n"]) * CONTRIBUTION

    def better(v: str, p: str, sign: int, ahead, behind) -> np.ndarray:
        a, b = x[v] * (1 + sign * handicap), x[p] * (1 + sign * handicap)
        return ahead(a, best[v]) | (~ahead(a, best[v]) & ~behind(a, best[v]) & ahead(b, best[p]))

    faster, slower, cheaper, dearer = x["t"] < best["t"], x["t"] > best["t"], x["j"] < best["j"], x["j"] > best["j"]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (best["t"] / x["t"] - 1) / (x["j"] / best["j"] - 1)
        loss = (x["t"] / best["t"] - 1) / (best["j"] / x["j"] - 1)
    weighed = np.select([~cheaper & ~dearer, ~faster & ~slower, slower & dearer, faster & cheaper, faster & dearer], [faster, cheaper, np.zeros_like(faster), np.ones_like(faster), gain >= limit], loss < limit)
    by = {
        "PERF": better("t", "pt", 1, _less, _more), "ENERGY": better("j", "pj", -1, _less, _more),
        "POWER-DELAY": better("pdp", "ppdp", -1, _more, _less), "ENERGY-DELAY": better("edp", "pedp", -1, _more, _less), "PERF-PER-J": weighed}
    return np.select([target == k for k in by], list(by.values()), False)


_PREDICTED = ("t", "j", "pdp", "edp", "pt", "pj", "ppdp", "pedp")
_FOUND = "case long, T long, n int, scores array<double>, sec double, joules double, pdp double, edp double"


def _searched(problems: DataFrame, listed: list[Case], most: int, rounds: int, even: bool) -> DataFrame:
    """The accepted case of each problem, cases taken in order; those whose split drops a unit count only if there is no choice."""
    columns = ["D1", "D2", "D3", "loc_a", "loc_b", "loc_c"]
    # equal problems have equal answers: each is searched for once, and by many tasks however few bytes they are
    kinds = staged(problems.select(*columns, "target").distinct(), "problem_kinds")
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))).alias("units")
    shapes = kinds.select("D1", "D2", "D3").distinct().select("*", numbers)
    tiles = tn.best_tile(shapes.withColumn("pid", F.struct("D1", "D2", "D3", "units")))
    ordered = F.array_sort(F.collect_list(F.struct("pid.units", "T", "slowdown")))
    by_shape = tiles.groupBy("pid.D1", "pid.D2", "pid.D3").agg(ordered.alias("l")).select("D1", "D2", "D3", F.transform("l", lambda x: x["T"]).alias("tile"), F.transform("l", lambda x: x["slowdown"]).alias("slow"))
    tasks = int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = kinds.join(by_shape, ["D1", "D2", "D3"]).repartition(tasks, *columns, "target").select(F.struct(*columns, "target").alias("kind"), *columns, "target", "tile", "slow")
    alone = len(listed) == 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            p = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns}
            target = np.array(batch.column("target").to_pylist(), dtype=object)
            if unknown := set(target) - set(TARGETS):
                raise ValueError(f"there are no such targets: {sorted(map(str, unknown))}")
            tile, slow = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(size, most) for c in ("tile", "slow"))
            best, found = None, np.zeros(size, bool)
            scores, case, kept_tile = [None] * size, np.zeros(size, np.int64), np.zeros(size, np.int64)
            for c in listed:
                n = len(c.units)
                x = split(c, p, slow[:, n - 1], target, rounds, even)
                x["n"] = np.full(size, n)
                if best is None:
                    best = {k: x[k].copy() for k in ("n", *_PREDICTED)}
                takes = (~found | accepts(x, best, target)) & (alone | (x["scores"] > 0).all(1))
                for k in best:
                    best[k][takes] = x[k][takes]
                for k in np.flatnonzero(takes):
                    scores[k] = x["scores"][k]
                case[takes], kept_tile[takes] = c.number, tile[takes, n - 1]
                found |= takes
            out = [batch.column("kind"), case, kept_tile, best["n"].astype(np.int32), pa.array(scores, pa.list_(pa.float64())), *(best[k] for k in ("t", "j", "pdp", "edp"))]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], ["kind", *(c.split()[0] for c in _FOUND.split(", "))]).filter(pa.array(found))

    found = staged(df.mapInArrow(search, f"kind {dict(df.dtypes)['kind']}, {_FOUND}"), "problem_answers")
    met = problems.join(small_side(found), [problems[c] == F.col(f"kind.{c}") for c in (*columns, "target")])
    return met.select("pid", *(c.split()[0] for c in _FOUND.split(", ")))


def best_subset(problems: DataFrame, weights: DataFrame, lookup: DataFrame, units: int, most: int | None = None) -> DataFrame:
    """``(pid, case, T, n, scores, sec, joules, pdp, edp)`` that the search ends with for each gemm.

    ``problems``: ``(pid, D1, D2, D3, loc_a, loc_b, loc_c, target)``. The tile of a case is the one of least slowdown for its number
    of units. A case whose split drops a unit is left out: the subset without it is a case of its own.
    """
    return _searched(problems, cases(weights, lookup, units, most), most or units, ROUNDS, False)


def best_split(problems: DataFrame, weights: DataFrame, lookup: DataFrame, units: int, even: bool = False) -> DataFrame:
    """The same over all units, which are given; ``even`` gives each as much."""
    return _searched(problems, cases(weights, lookup, units)[-1:], units, ROUNDS, even)
