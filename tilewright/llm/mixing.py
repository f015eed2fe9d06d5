"""Mixing sources to target weights: hash order, distributed prefix sums, exact cuts.

Every row has a hash-random key; within its source the rows stand in the order of the
keys. A source whose target is e whole epochs and some words more gives every row e
times, and the rows at the head of its order once more until those words are used up.
The place of that cut is found in two steps: prefix sums over ranges of keys, as many
a source as its rows ask for, then over the rows of the one range that the cut falls
in. What comes out is one row a source, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, small_side, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows of a source in a range of keys, about.
RANGE_ROWS = 1 << 14


def words(text: Column) -> Column:
    """Number of words that ASCII white space parts; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(ids: Column, seed: str) -> Column:
    """32 hex digits that look random, from the id alone; null ids share one key."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ids.cast("string"), F.lit(""))).cast("binary"))


def key_range(key: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal parts of the key space a key is in, in order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def by_code_point(source: Column) -> Column:
    """Sorts as the source's code points do; null last in ascending order."""
    return source.asc_nulls_last()


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, n_rows, target)`` from ``(source, size)`` rows.

    The sources, by code point and null last, have the weights in turn and share
    ``share`` times all sizes; none gets over ``cap`` times its own size, and what it
    leaves is shared by weight among the others until none is above. That is
    target = least(cap * size, level * weight) with one level for all; the sources that
    are full are those of least cap * size / weight.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    own = staged(own, "sources")
    place = F.row_number().over(W.orderBy(by_code_point(F.col("source"))))
    weighed = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double"))
    full = F.col("source_size") * cap
    order = W.orderBy(full / F.col("weight"), by_code_point(F.col("source")))
    all_rows = W.partitionBy()
    counted = weighed.select(
        "*",
        F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
        (F.sum("source_size").over(all_rows) * share).alias("whole"),
    )
    level = (F.col("whole") - F.col("before")) / F.col("open_weight")
    open_here = F.col("weight") * level <= full
    found = counted.withColumn("level", F.min(F.when(open_here, F.struct("before", level.alias("level")))).over(all_rows)["level"])
    return found.select("source", "source_size", "n_rows", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight"))).alias("target"))


def cuts(rows: DataFrame, plan: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``plan`` with ``epochs``, ``cut_key``, ``cut_taken`` and ``cut_size`` for each source.

    ``rows`` are ``(source, size, key)``. Beyond ``epochs`` full turns, rows of keys
    below ``cut_key`` are taken once more, and of those that have it (one row, but for
    repeated ids) ``cut_taken`` of their ``cut_size`` words. A null ``cut_key``: none.
    """
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.select(
        "*", budget.alias("budget"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / range_rows)).cast("long").alias("ranges"),
    )
    plan = staged(plan.withColumn("left_over", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix_plan")
    same = lambda a, b: a.eqNullSafe(b)
    p = small_side(plan.select(F.col("source").alias("s"), "ranges", "left_over"))
    ranged = rows.join(p, same(F.col("source"), F.col("s"))).select("source", "size", "key", "left_over", key_range(F.col("key"), F.col("ranges")).alias("range"))
    totals = ranged.groupBy("source", "range", "left_over").agg(F.sum("size").alias("total"))
    up_to = F.sum("total").over(W.partitionBy("source").orderBy("range"))
    hit = totals.withColumn("begin", up_to - F.col("total")).where((F.col("begin") < F.col("left_over")) & (F.col("begin") + F.col("total") >= F.col("left_over")))
    hit = staged(hit.select(F.col("source").alias("s"), F.col("range").alias("r"), "begin"), "mix_range")
    inside = ranged.join(small_side(hit), same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")))
    keyed = inside.groupBy("source", "key", "left_over", "begin").agg(F.sum("size").alias("key_size"))
    running = F.col("begin") + F.sum("key_size").over(W.partitionBy("source").orderBy("key"))
    cut = (
        keyed.select("*", running.alias("end"))
        .where((F.col("end") >= F.col("left_over")) & (F.col("end") - F.col("key_size") < F.col("left_over")))
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("left_over") - F.col("end") + F.col("key_size")).alias("cut_taken"), F.col("key_size").alias("cut_size"))
    )
    return plan.join(cut, same(F.col("source"), F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_taken", "cut_size")


def once_more() -> Column:
    """Words of a row that the mix takes beyond its source's full epochs."""
    part = F.floor(F.col("size") * F.col("cut_taken") / F.col("cut_size")).cast("long")
    return F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), part).otherwise(F.lit(0).cast("long"))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, share: float, cap: float) -> DataFrame:
    sized = docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
    sized = staged(sized, "mix_sizes")
    return staged(cuts(sized, targets(sized, share, cap)), "mix_cuts")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row.

    ``taken`` counts repeats; a source's sum to its target rounded to a whole word, the
    row at the cut giving a part of its words. Null and wordless texts have size 0 and
    give 0. Rows that repeat an id share a key; at the cut they share its words in
    proportion, rounded down. A null source is a source. Reruns agree: keys hang on the
    id and ``seed`` alone. Other columns don't matter. Empty in, empty out.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
    sized = staged(sized, "mix_sizes")
    plan = staged(cuts(sized.drop("id"), targets(sized, share, cap)), "mix_cuts").withColumnRenamed("source", "s")
    joined = sized.join(small_side(plan), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once_more()).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged.

    The row at a source's cut comes once more if half its words or more were taken: a
    document is never cut in two. Rows taken no time go. Texts aren't shuffled: the cut
    of each source is joined to them.
    """
    plan = planned(docs, id_col, text_col, source_col, seed, share, cap)
    name, source, turn = (fresh(docs, c) for c in ("_plan", "_source", "_turn"))
    plan = plan.select(F.struct("epochs", "cut_key", "cut_taken", "cut_size").alias(name), F.col("source").alias(source))
    key, cut = random_key(F.col(id_col), seed), F.col(name)
    last = F.when(key < cut["cut_key"], 1).when((key == cut["cut_key"]) & (2 * cut["cut_taken"] >= cut["cut_size"]), 1).otherwise(0)
    joined = docs.join(small_side(plan), F.col(source_col).eqNullSafe(F.col(source)))
    times = (cut["epochs"] + last).cast("int")
    return joined.where(times > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(turn)).drop(turn)
