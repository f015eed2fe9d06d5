"""Orders, ranks, quantiles and as-of joins of tables whose groups don't fit a task.

Rows are cut into ranges of the whole order, as Spark samples it (``repartitionByRange``); what a
range needs to know of those before it, a count, a running sum or the last row, is carried over from one row a range
and group. So a group may have all rows of the table: its ranges are as even as any others.
The ranged rows are written once, so what follows sees one and the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.sources.paths import small_side, staged

#: Column with the number of a row's range.
RANGE = "_range"


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used on the way; rename them")


def ranged(df: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, which rises with (``by``, ``order``); written. Rows that are equal in all of these stay in one range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *map(F.col, by), *order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def _earlier(by: list[str]):
    """The ranges of a group before each, in a table of a row a range and group."""
    return W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)


def _keys(by: list[str]) -> list[Column]:
    return [*(F.col(c).alias(f"_{c}") for c in by), F.col(RANGE).alias("_r")]


def _met(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(RANGE) == F.col("_r")]
    return rows.join(small_side(staged(carried, "carried")), on).drop(*(f"_{c}" for c in by), "_r")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in ``order`` within its group ``by`` (none: the whole table).

    Null keys are a group. Rows equal in ``order`` come in any order, so make it a total one for a result that reruns agree on.
    """
    _free(df, name, RANGE, "_n", "_before", "_r", *(f"_{c}" for c in by))
    rows = ranged(df, by, order, ranges)
    counts = rows.groupBy(RANGE, *by).agg(F.count("*").alias("_n"))
    carried = counts.select(*_keys(by), F.sum("_n").over(_earlier(by)).alias("_before"))
    met = _met(rows.withColumn(name, F.row_number().over(W.partitionBy(RANGE, *by).orderBy(*order))), carried, by)
    return met.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", RANGE)


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None, until: Column | None = None) -> DataFrame:
    """``df`` with running sums, each row's own value included, in ``order`` within its group; values are doubles or longs, null counts nothing.

    ``until``, a condition on the sums and ``by``, leaves a group's rows out that come in ranges after the first at whose end it holds.
    """
    _free(df, RANGE, "_r", "_done", *(f"_{c}" for c in by), *(f"_{n}" for n in sums), *sums)
    rows = ranged(df, by, order, ranges)
    totals = rows.groupBy(RANGE, *by).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = totals.select(*by, RANGE, *(F.sum(n).over(_earlier(by)).alias(n) for n in sums))
    if until is not None:
        so_far = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, 0)
        before = before.withColumn("_done", F.max(F.coalesce(until, F.lit(False))).over(so_far)).where("NOT _done")
    carried = before.select(*_keys(by), *(F.col(n).alias(f"_{n}") for n in sums))
    own = W.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # joined before the window, so that what is left out isn't sorted
    met = _met(rows, carried, by).withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    return met.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in sums}).drop(*(f"_{n}" for n in sums), RANGE)


def write_ordered(df: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Text of ``df``'s one string column in part files whose names rise with ``order``, each sorted: read by name, they are the whole order.

    ``order`` may use other columns; the first column is written. An empty table writes no lines.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(df.columns[0]).write.text(path)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, fields: list[str], ranges: int | None = None) -> DataFrame:
    """Every row of ``left`` with the ``fields`` of the last row of ``right`` in its group whose ``at`` isn't beyond its own.

    Rows before all of their group get the group's first row; groups without any, nulls. ``at_found`` is that row's ``at``. Of rows of
    ``right`` that are equal in ``by`` and ``at``, the one of greatest fields counts; such with a null ``at`` count for
    nothing, and a left row with a null ``at`` gets nulls. Null keys are a group. Neither side need be small.
    """
    _free(left, *fields, "at_found", "_found", "_side", RANGE, "_r", "_last", "_first", "_tie", *(f"_{c}" for c in by))
    kind = {c: left.schema[c].dataType for c in [*by, at]}
    rights = right.where(F.col(at).isNotNull()).groupBy(*(F.col(c).cast(kind[c]).alias(c) for c in [*by, at])).agg(F.max(F.struct(*fields)).alias("_found"))
    rights = rights.select(*by, at, F.struct(F.col(at).alias("at_found"), "_found.*").alias("_found"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    lefts = left.withColumns({"_side": F.lit(1), "_tie": F.xxhash64(*left.columns)})
    rows = ranged(lefts.unionByName(rights, allowMissingColumns=True), by, [F.col(at), F.col("_side"), F.col("_tie")], ranges)
    own = W.partitionBy(RANGE, *by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    parts = rows.groupBy(RANGE, *by).agg(F.max("_found").alias("_last"), F.min("_found").alias("_first"))
    carried = parts.select(*_keys(by), F.max("_last").over(_earlier(by)).alias("_last"), F.min("_first").over(W.partitionBy(*by)).alias("_first"))
    met = _met(rows.withColumn("_found", F.last("_found", ignorenulls=True).over(own)), carried, by).where("_side = 1")
    taken = F.when(F.col(at).isNotNull(), F.coalesce("_found", "_last", "_first"))
    return met.withColumn("_found", taken).select(*left.columns, "_found.*")


#: Cuts of a bracket in a round, and the accuracy of the sketch that finds them (its error is a tenth of a cut).
CUTS, ACCURACY = 1024, 10_000
#: Values of a bracket that one task ranks at most.
BRACKET = 1 << 14


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], bracket: int = BRACKET) -> DataFrame:
    """``(*by, n, q)``: exact quantiles of ``value`` for each group, interpolated between the two values that a share falls between.

    By selection: a mergeable sketch brackets the values of the wanted ranks, an exact count says how many stand before a
    bracket and at its edges, and what is inside is bracketed again until it is few, then ranked. So no task holds a group, whatever its
    size, and values that repeat are an edge, never an inside, once they weigh more than a cut. Nulls and NaN
    are left out (a group without any other value isn't there); null keys are a group.
    """
    _free(df.select(*by), "n", "q", "v", "t")
    rows = staged(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).cast("double").alias("v")), "quantile_rows")
    grid = F.array(*(F.lit(k / CUTS) for k in range(CUTS + 1)))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("cuts"))
    ranks = sorted({(k, up) for k in range(len(shares)) for up in (False, True)})
    rank = lambda k, up: (F.ceil if up else F.floor)((F.col("n") - 1) * F.lit(float(shares[k]))).cast("long")
    each = F.array(*(F.struct(F.lit(t).alias("t"), rank(k, up).alias("rank")) for t, (k, up) in enumerate(ranks)))
    targets = groups.select("g", "n", "cuts", F.explode(each).alias("e")).select("g", "n", "cuts", "e.t", "e.rank", F.col("e.rank").alias("inner"), F.col("n").alias("inside"))
    targets, done = staged(_bracketed(targets), "quantile_targets"), []
    while True:
        counted = staged(_counted(rows, targets), "quantile_counts")
        left = counted.where("found IS NULL")
        done.append(counted.where("found IS NOT NULL").select("g", "n", "t", F.col("found").alias("v")))
        small = left.where(F.col("inside") <= bracket)
        done.append(_ranked_inside(rows, small))
        wide = left.where(F.col("inside") > bracket)
        if wide.isEmpty():
            break
        met = _inside(rows, wide).groupBy("g", "t").agg(F.percentile_approx("v", grid, ACCURACY).alias("cuts"))
        again = wide.select("g", "n", "t", "rank", F.col("inner"), "inside").join(met, ["g", "t"])
        targets = staged(_bracketed(again), "quantile_targets")
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    got = values.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))

    def share(k: int) -> Column:
        low, high = (F.element_at("m", ranks.index((k, up))) for up in (False, True))
        p = (F.col("n") - 1) * F.lit(float(shares[k]))
        return F.when(low == high, low).otherwise(low + (p - F.floor(p)) * (high - low))

    return got.select(*(F.col(f"g.{c}").alias(c) for c in by), "n", F.array(*(share(k) for k in range(len(shares)))).alias("q"))


def _bracketed(targets: DataFrame) -> DataFrame:
    """``lo`` and ``hi`` of each target, two cuts on either side of where rank ``inner`` of ``inside`` values falls."""
    place = F.floor(F.col("inner") * F.lit(CUTS) / F.col("inside")).cast("int")
    at = lambda k: F.element_at("cuts", F.greatest(F.lit(0), F.least(F.lit(CUTS), k)) + 1)
    few = F.col("inside") <= CUTS
    lo = F.when(few, F.element_at("cuts", 1)).otherwise(at(place - 2))
    hi = F.when(few, F.element_at("cuts", -1)).otherwise(at(place + 3))
    return targets.select("g", "n", "t", "rank", lo.alias("lo"), hi.alias("hi"))


def _counted(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with ``found``, if its rank is at an edge of its bracket, else with ``inner``, its rank among the ``inside`` values."""
    own = targets.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("t", "lo", "hi"))).alias("ts"))
    most = 1 + (targets.agg(F.max("t")).first()[0] or 0)
    v = F.col("v")
    # a column of counts for each target, combined before anything is sent
    t = lambda k, f: F.get(F.filter("ts", lambda x: x["t"] == k), F.lit(0))[f]
    wide = own.select("g", *(t(k, f).alias(f"{f}{k}") for k in range(most) for f in ("lo", "hi")))
    joined = rows.join(small_side(staged(wide, "quantile_brackets")), "g")
    lo, hi = (lambda k: F.col(f"lo{k}")), (lambda k: F.col(f"hi{k}"))
    counts = [F.struct(F.lit(k).alias("t"), F.count_if(v < lo(k)).alias("before"), F.count_if(v == lo(k)).alias("at_lo"), F.count_if((v > lo(k)) & (v < hi(k))).alias("inside"), F.count_if(v == hi(k)).alias("at_hi")) for k in range(most)]
    found = joined.groupBy("g").agg(F.array(*counts).alias("c")).select("g", F.explode("c").alias("c")).select("g", "c.*")
    inner = F.col("rank") - F.col("before") - F.col("at_lo")
    edge = F.when(inner < 0, F.col("lo")).when(inner >= F.col("inside"), F.col("hi"))
    return targets.join(found, ["g", "t"]).select("g", "n", "t", "rank", "lo", "hi", inner.alias("inner"), "inside", edge.alias("found"))


def _inside(rows: DataFrame, targets: DataFrame) -> DataFrame:
    own = targets.groupBy("g").agg(F.collect_list(F.struct("t", "lo", "hi")).alias("ts"))
    hit = F.filter("ts", lambda x: (F.col("v") > x["lo"]) & (F.col("v") < x["hi"]))
    return rows.join(small_side(staged(own, "quantile_open")), "g").select("g", "v", F.explode(hit).alias("x")).select("g", "v", "x.t")


def _ranked_inside(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The values of targets whose bracket holds few values."""
    counts = _inside(rows, targets).groupBy("g", "t", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("g", "t").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    met = counts.withColumn("upto", upto).join(targets.select("g", "t", "n", "inner"), ["g", "t"])
    return met.where("inner < upto AND inner >= upto - c").select("g", "n", "t", "v")
