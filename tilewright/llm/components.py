"""Connected components by randomised contraction (Bögeholz, Brand and Todor, 2020).

Each round every vertex moves to the neighbour, itself included, of least keyed
hash; edges are contracted to the images. The expected number of vertices falls
by a constant factor a round whatever the shape of the graph, so chains take
logarithmically many rounds. Every round is two grouped joins; nothing is
collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_side, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every vertex of ``edges``; vertices are longs.

    Two vertices have the same root exactly if a path joins them. Null ends and
    loops are ignored; repeated edges don't matter. An empty table gives one.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = staged(edges.distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(moves))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("k"))
        move = staged(least.select(F.col("a").alias("node"), F.least("k", ranked("a"))["v"].alias("root")), "moves")
        moves.append(move)
        m = small_side(move)
        contracted = (
            edges.join(m.withColumnRenamed("root", "ra"), F.col("a") == F.col("node")).drop("node")
            .join(m.withColumnRenamed("root", "rb"), F.col("b") == F.col("node"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a <> b").distinct()
        )
        edges = staged(contracted, "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        later = small_side(roots).select(F.col("node").alias("via"), F.col("root").alias("end"))
        roots = staged(moves.pop().join(later, F.col("root") == F.col("via"), "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return roots
