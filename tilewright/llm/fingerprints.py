"""One-permutation MinHash fingerprints of texts.

The five-word shingles of a text are hashed once; the top bits of a hash say its bin, and each bin
keeps its least hash. An empty bin takes the value of another: it draws bins in an order of its own, the same for
every text, until one isn't empty (optimal densification). Stored are the low bits of each bin's value, packed. Two
values that differ agree in ``BITS`` bits by chance once in ``2^BITS``, so the share of equal bins is corrected for that.

Sorted hashes stand by bin with each bin's least first, so all of it is array functions over a row;
nothing is spelled out as rows and nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a shingle, bins of a fingerprint (2^BIN_BITS) and low bits kept of each (two hexadecimal digits).
SHINGLE, BIN_BITS, BITS = 5, 7, 8
BINS = 1 << BIN_BITS
#: Bins in a packed long.
PER_LONG = 64 // BITS
#: Rows of a range in the order of the documents, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once: a lambda's variable isn't put in again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """What ASCII white space parts."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def shingle_hashes(text: Column) -> Column:
    """XXH64 hashes of every five words in a row, by the words' hashes; of fewer words, that of all of them."""

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda k: F.xxhash64(*(F.get(w, k + d) for d in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array(F.xxhash64(w)))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), windows)  # noqa: PLW0108


def least_of_bins(hashes: Column) -> Column:
    """The least hash of each bin that has one, in the bins' order."""
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS)
    firsts = lambda h: F.filter(h, lambda x, k: (k == 0) | (bin_of(x) != bin_of(F.get(h, k - 1))))
    return let(F.sort_array(hashes), firsts)


def densified(least: Column) -> Column:
    """A value for each of ``BINS`` bins, in order.

    Bin j draws bins in an order of its own, every one in the end: the turn of bin b is (b s + c) mod BINS, with c and an odd s from j.
    """
    number = lambda h: (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")
    bits = lambda j, k: F.xxhash64(j, F.lit(k)).bitwiseAND(BINS - 1).cast("int")
    all_bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def drawn(have: Column) -> Column:
        """Of the bins ``have``, each bin's own or the first that it draws: BINS times the bin and the place among them."""
        turn = lambda b, k, s, c: (b * s + c).bitwiseAND(BINS - 1) * BINS + k
        pick = lambda s, c: F.array_min(F.transform(have, lambda b, k: turn(b, k, s, c))).bitwiseAND(BINS - 1)
        fill = lambda j: let(bits(j, 0).bitwiseOR(1), lambda s: let(bits(j, 1), lambda c: j * BINS + pick(s, c)))
        own = F.transform(have, lambda b, k: b * BINS + k)
        return F.sort_array(F.concat(own, F.transform(F.array_except(all_bins, have), fill)))

    return let(least, lambda own: F.transform(let(F.transform(own, number), drawn), lambda x: F.get(own, x.bitwiseAND(BINS - 1))))


def packed(values: Column) -> Column:
    """The low bits of the bins' values, ``PER_LONG`` to a long."""
    low = lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND((1 << BITS) - 1))
    longs = F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1))
    return let(values, lambda v: F.transform(longs, lambda g: F.aggregate(F.slice(v, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), low)))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text; a null text's is the empty one's.

    Texts of fewer than five words have one shingle, all their words; texts without words are alike. Texts of the same words have the
    same fingerprint whatever parts the words.
    """
    return packed(densified(least_of_bins(shingle_hashes(F.coalesce(text, F.lit(""))))))


def shown(fp: Column) -> Column:
    """A fingerprint as lowercase hexadecimal digits, two for each bin."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two texts' shingles as their fingerprints tell it, 0 to 1."""
    ones = sum(1 << BITS * k for k in range(PER_LONG))

    def unequal(x: Column, y: Column) -> Column:
        z, shift = x.bitwiseXOR(y), 1
        while shift < BITS:
            z, shift = z.bitwiseOR(F.shiftrightunsigned(z, shift)), 2 * shift
        return F.bit_count(z.bitwiseAND(ones))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - differing / BINS - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` for every row; other columns don't matter. Empty in, empty out."""
    return docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fingerprint"))


def _starts(rows: DataFrame, range_rows: int) -> list[dict]:
    """The first ``(id, tie)`` of each range of the descending order, as Spark's own sample cuts it."""
    wanted = min(MOST_RANGES, -(-rows.count() // range_rows))
    if not wanted:
        return []
    ranged = rows.select("id", "tie").repartitionByRange(wanted, F.col("id").desc_nulls_last(), F.col("tie").desc())
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "tie")).alias("k")).select("k.*").sort(F.col("id").desc_nulls_last(), F.col("tie").desc())
    return [r.asDict() for r in first.collect()]  # MOST_RANGES at most


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(id, text, fingerprint, next_text, next_fingerprint)``: each row and the one that follows it in descending order of ids; the first follows the last.

    Equal ids stand in an order by their texts' hashes, null ids last. The order is cut into ranges; the first row of
    each also goes behind the range before it, so a window over a range sees every next row and no task has more than a range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    starts = _starts(rows, range_rows)
    n = len(starts)
    kind = rows.schema["id"].dataType.simpleString()
    bounds = F.from_json(F.lit(dumps(starts, default=str)), f"array<struct<id: {kind}, tie: bigint>>")

    def reached(b: Column) -> Column:
        """Whether the range that begins with ``b`` begins with or before the row."""
        later = F.coalesce(b["id"] > F.col("id"), b["id"].isNotNull() & F.col("id").isNull())
        return later | (b["id"].eqNullSafe(F.col("id")) & (b["tie"] >= F.col("tie")))

    strides = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    count = F.aggregate(strides, F.lit(0), lambda at, s: F.when((at + s <= n) & reached(F.get(bounds, at + s - 1)), at + s).otherwise(at))
    ranged = rows.withColumns({"range": F.greatest(count - 1, F.lit(0)), "fingerprint": fingerprint(F.col("text"))})
    start = F.get(bounds, F.col("range"))
    first = start["id"].eqNullSafe(F.col("id")) & (start["tie"] == F.col("tie"))
    own = F.struct(F.col("range").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, F.lit(max(n, 1))).alias("part"), F.lit(True).alias("guest"))
    placed = ranged.select("id", "text", "tie", "fingerprint", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("id", "text", "tie", "fingerprint", "at.*")
    order = W.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    found = placed.select("id", "text", "fingerprint", "guest", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return found.where(~F.col("guest")).drop("guest")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has, in place of the last half (rounded down) of the code points, as many of the first ones of the next
    row (or all it has) in descending order of ids. ``near_edited`` is the likeness of the row's
    fingerprint to that of the edited text, ``near_next`` to the next row's. Null texts are empty ones; a table of one row is its own
    next; equal ids: see :func:`with_next`. Repeated rows follow each other. Very long texts are taken whole. Empty in, empty out.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.char_length("text") - half), F.left(F.col("next_text"), half))
    halved = with_next(docs, id_col, text_col, range_rows).select("id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    found = halved.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return found.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
