"""Sharding by proportional stratified interleaving.

The rows of each source, shuffled by a seeded hash, get fractional ranks (place - 1/2)
/ rows; sorted by that, every stretch of the whole order holds the sources in their
proportions. It is cut into shards of equal row counts (law ``rows``).

Places come from counts by range and a window within each range, so no source and no
shard is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import small_side, staged
from tilewright.llm.mixing import RANGE_ROWS, by_code_point, key_range, random_key


def _placed(rows: DataFrame, group: list[str], range_of: str, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 within ``group``: ranges ``range_of`` rise with ``order``."""
    counts = rows.groupBy(*group, range_of).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy(range_of).rowsBetween(W.unboundedPreceding, -1)
    offsets = staged(counts.select(*[F.col(c).alias(f"_{c}") for c in [*group, range_of]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, range_of]]
    within = F.row_number().over(W.partitionBy(*group, range_of).orderBy(*order))
    return rows.withColumn("_within", within).join(small_side(offsets), on).withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_within", "_before", *[f"_{c}" for c in [*group, range_of]])


def size_of(text: Column) -> Column:
    """UTF-8 bytes and one more; null has the one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    Law ``rows``: shard counts differ by one at most; slots of a shard run from 0 in the
    interleaved order. ``grown_shard`` is null under that law. Null texts are empty ones;
    a null source is a source; null ids share a key. Rows that repeat an id are told
    apart by text hash and size; whole repeats are alike, so any order of them is
    the same. Reruns agree. Fewer rows than shards: some shards stay empty. Empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), random_key(F.col(id_col), seed).alias("key"),
    )
    rows = staged(rows, "shard_rows")
    own = staged(rows.groupBy("source").agg(F.count("*").alias("n_source")), "shard_sources")
    total = own.agg(F.sum("n_source")).first()[0] or 0
    ranges = F.ceil(F.col("n_source") / range_rows).cast("long")
    ranged = rows.join(small_side(own.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("range", key_range(F.col("key"), ranges))
    order = ["key", "text_crc32", "size"]
    placed = _placed(ranged, ["source"], "range", order, "place")
    fraction = (2 * F.col("place") + 1) / (2 * F.col("n_source"))
    whole = max(1, -(-total // range_rows))
    spread = staged(placed.drop("range").withColumn("fraction", fraction).withColumn("range", F.floor(F.col("fraction") * whole).cast("long")), "shard_fractions")
    ranked = _placed(spread, [], "range", ["fraction", by_code_point(F.col("source"))], "rank")
    n = max(total, 1)
    # exact in integers: the shard whose first rank, ceil(shard * n / shards), is the last not beyond
    number = F.expr(f"rank * {shards} div {n}")
    first = F.expr(f"((rank * {shards} div {n}) * {n} + {shards - 1}) div {shards}")
    return ranked.select(
        "id", "size", "text_crc32", F.lit("rows").alias("law"), number.cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
