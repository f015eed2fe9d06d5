"""Dense linear algebra over DataFrames.

A matrix is a table of cells ``(i, j, v)`` or of rows ``(i, row)``, a vector one of ``(i, v)``; a missing
cell is zero. Products of cells are made on a replicated grid (:func:`gemm`, :func:`gemm_blocked`): the index
space of rows, columns and inner index is cut into p x q x r boxes, each box gets its parts of A and B, multiplies them densely,
and the r partial products of a cell are summed. No index is a key on its own, so neither a short inner dimension nor a skewed one
holds the work in a few tasks, and no product of two cells is a row. Two forms need no shuffle of A: a
tall matrix times a small one (:func:`gemm_small`), and the product of two tall ones along their length (:func:`gemm_tall`, :func:`syrk_tall`).

``single`` takes operands and scalars as float, sums in double and rounds the result to float.
``plan`` (tile size ``T`` and ``units``, from a tuner) says how, never what: with a tile size
matrices are multiplied by tiles and inner products summed by tile first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.sources.paths import staged

#: A matrix of at most so many cells may be sent to every task.
SMALL_CELLS = 1 << 20

#: Cells of a part of A, B or C that a box of the grid holds, at most.
BOX_CELLS = 1 << 18


def cells(df: DataFrame, index: str, values: str) -> DataFrame:
    """``(i, j, v)`` of a table with one array a row."""
    return df.select(F.col(index).alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def rows(matrix: DataFrame) -> DataFrame:
    """``(i, row)``: the cells of each row in the order of ``j``."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "v")))
    return matrix.groupBy("i").agg(F.transform(ordered, lambda c: c["v"]).alias("row"))


def transposed(matrix: DataFrame, flag: str = "T") -> DataFrame:
    """Swaps the index columns if ``flag`` is T; no data moves."""
    if flag not in ("N", "T"):
        raise ValueError(f"a transpose flag is N or T, not {flag!r}")
    return matrix if flag == "N" else matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _scalar(x: float, single: bool = False) -> Column:
    return F.lit(float(np.float32(x))) if single else F.lit(float(x))


def _operand(table: DataFrame, single: bool) -> DataFrame:
    return table.withColumn("v", F.col("v").cast("float").cast("double")) if single else table


def _result(table: DataFrame, single: bool) -> DataFrame:
    return table.withColumn("v", F.col("v").cast("float")) if single else table


def _plus(product: DataFrame, on: list[str], c: DataFrame | None, alpha: float, beta: float, single: bool = False) -> DataFrame:
    """alpha * product + beta * c; with beta 0, ``c`` isn't read."""
    product = product.select(*on, (_scalar(alpha, single) * F.col("v")).alias("v"))
    if c is None or beta == 0:
        return product
    c = _operand(c, single).select(*on, F.col("v").alias("w"))
    total = F.coalesce("v", F.lit(0.0)) + _scalar(beta, single) * F.coalesce("w", F.lit(0.0))
    return product.join(c, on, "full").select(*on, total.alias("v"))


#: How partial products along the inner dimension meet C.
MODES = ("WR", "WR_LAZY", "W_REDUCE")


def _reduced(partial: DataFrame, c: DataFrame | None, alpha: float, beta: float, mode: str, split: bool = True) -> DataFrame:
    """Partial products ``(i, j, v)`` summed, and beta C once. The modes differ in where C comes in, not in the value.

    ``WR``: C, times beta, is the first of the terms; ``WR_LAZY``: it is fetched after the sum
    is done; ``W_REDUCE``: sums are reduced once more together with it.
    """
    if mode not in MODES:
        raise ValueError(f"there is no reduction mode {mode!r}")
    terms = partial.select("i", "j", (F.lit(float(alpha)) * F.col("v")).alias("v"))
    if c is None or beta == 0 or mode == "WR_LAZY":
        return _plus(_summed(partial, split), ["i", "j"], c, alpha, beta)
    scaled = c.select("i", "j", (F.lit(float(beta)) * F.col("v")).alias("v"))
    if mode == "W_REDUCE" and split:
        terms = terms.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return terms.unionByName(scaled).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans_a: str = "N", trans_b: str = "N", single: bool = False, plan: dict | None = None, mode: str = "WR_LAZY") -> DataFrame:
    """C <- alpha op(A) op(B) + beta C, all as cells."""
    size = int(plan["T"]) if plan and plan.get("T") else 1
    partial, split = _boxed(_operand(transposed(a, trans_a), single), _operand(transposed(b, trans_b), single), size)
    if not single:
        return _reduced(partial, c, alpha, beta, mode, split)
    return _result(_plus(_summed(partial, split), ["i", "j"], c, alpha, beta, True), True)


def _summed(partial: DataFrame, split: bool = True) -> DataFrame:
    """Partial products by cell; if the inner dimension wasn't split, they are whole already."""
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v")) if split else partial


def grid_of(m: int, n: int, k: int, tasks: int, box_cells: int = BOX_CELLS) -> tuple[int, int, int]:
    """Boxes along the rows, columns and inner index of an m x k by k x n product: (p, q, r).

    Of the grids of powers of two that give every task a box, and boxes of ``box_cells`` cells of A, B and C at most, the one that
    moves the fewest cells: A goes to q boxes, B to p, and C is summed from r where r is over 1.
    """

    def powers(most: int) -> list[int]:
        return [1 << x for x in range(max(1, most).bit_length())]

    part = lambda size, parts: -(-size // parts)
    best = None
    for p in powers(m):
        for q in powers(n):
            for r in powers(k):
                x, y, z = part(m, p), part(n, q), part(k, r)
                over = max(0, max(x * z, z * y, x * y) - box_cells)
                moved = m * k * q + k * n * p + (m * n * r if r > 1 else 0)
                best = min(best or (over, tasks, 0, 0, p, q, r), (over, max(0, tasks - p * q * r), moved, p * q * r, p, q, r))
    return best[-3:]


def _extent(cells_: DataFrame) -> tuple[int, int, int, int]:
    """First and last row and column that have a cell; an empty matrix has one row and column."""
    seen = cells_.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    return tuple(0 if x is None else x for x in seen)


def _boxed(a: DataFrame, b: DataFrame, size: int = 1) -> tuple[DataFrame, bool]:
    """Partial products ``(i, j, v)`` of A and B as cells, and whether a cell may have several.

    Both are read twice, for their extent first. Boxes' edges are multiples of ``size``. A cell of the product is there if
    there is an inner index at which both operands have a cell. Of repeated cells the sum counts.
    """
    i0, i1, ak0, ak1 = _extent(a)
    bk0, bk1, j0, j1 = _extent(b)
    k0, k1 = max(ak0, bk0), max(min(ak1, bk1), max(ak0, bk0))
    blocks_ = lambda low, high: high // size - low // size + 1
    spark = a.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    m, n, k = blocks_(i0, i1), blocks_(j0, j1), blocks_(k0, k1)
    p, q, r = grid_of(m, n, k, tasks, max(1, BOX_CELLS // (size * size)))
    box = lambda c, low, blocks, parts: F.expr(f"({c} div {size} - {low // size}) * {parts} div {blocks}")
    edge = lambda number, low, blocks, parts: (-(-number * blocks // parts) + low // size) * size
    copies = lambda parts, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(name)

    def parts(matrix: DataFrame, row: Column, column: Column, names: tuple[str, str], value: str) -> DataFrame:
        inside = matrix.where(f"{'j' if value == 'x' else 'i'} BETWEEN {k0} AND {k1}")
        cell = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
        return inside.groupBy(row.alias(names[0]), column.alias(names[1])).agg(F.collect_list(cell).alias(value))

    left = parts(a, box("i", i0, m, p), box("j", k0, k, r), ("gi", "gk"), "x").select("gi", copies(q, "gj"), "gk", "x")
    right = parts(b, box("i", k0, k, r), box("j", j0, n, q), ("gk", "gj"), "y").select(copies(p, "gi"), "gj", "gk", "y")

    def dense(column: pa.ListArray, at: int, low: tuple[int, int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray | None]:
        """A part as a matrix, and where it has cells unless that is everywhere."""
        flat = column.values.slice(column.offsets[at].as_py(), column.offsets[at + 1].as_py() - column.offsets[at].as_py())
        i, j = (flat.field(f).to_numpy() - x for f, x in zip(("i", "j"), low))
        v = flat.field("v").fill_null(0.0).to_numpy(zero_copy_only=False)
        place = i * shape[1] + j
        there = np.bincount(place, minlength=shape[0] * shape[1]).reshape(shape)
        return np.bincount(place, v, shape[0] * shape[1]).reshape(shape), None if there.all() else there > 0

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                gi, gj, gk = (batch.column(c)[at].as_py() for c in range(3))
                low = edge(gi, i0, m, p), edge(gj, j0, n, q), edge(gk, k0, k, r)
                high = edge(gi + 1, i0, m, p), edge(gj + 1, j0, n, q), edge(gk + 1, k0, k, r)
                rows_, columns, inner = (y - x for x, y in zip(low, high))
                x, has_x = dense(batch.column(3), at, (low[0], low[2]), (rows_, inner))
                y, has_y = dense(batch.column(4), at, (low[2], low[1]), (inner, columns))
                full = lambda has, shape: np.ones(shape, np.float32) if has is None else has.astype(np.float32)
                there = np.ones((rows_, columns), bool) if has_x is None and has_y is None else full(has_x, x.shape) @ full(has_y, y.shape) > 0
                i, j = np.nonzero(there)
                yield _cells(low[0] + i, low[1] + j, (x @ y)[i, j])

    joined = left.join(right, ["gi", "gj", "gk"]).select("gi", "gj", "gk", "x", "y")
    return joined.mapInArrow(multiply, "i long, j long, v double"), r > 1


def gemm_small(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """C <- alpha A B + beta C for ``a`` as ``(i, row)`` and a small B as cells, all of them given.

    B is written once, and goes to every task as one array of its columns if its size allows, else the product is :func:`gemm`'s;
    A isn't shuffled then and each product is a fold over two arrays.
    """
    b = staged(b, "operand")
    if b.count() > SMALL_CELLS:
        return gemm(cells(a, "i", "row"), b, c, alpha, beta)
    columns = b.groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("column"))
    whole = columns.agg(F.array_sort(F.collect_list(F.struct("j", "column"))).alias("columns"))
    inner = lambda x: F.aggregate(F.zip_with("row", x["column"], lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    product = a.join(F.broadcast(whole)).select("i", F.explode(F.transform("columns", lambda x: F.struct(x["j"].alias("j"), inner(x).alias("v")))).alias("c")).select("i", "c.j", "c.v")
    return _plus(product, ["i", "j"], c, alpha, beta)


def _dense(rows_: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix; a null cell is zero."""
    width = np.diff(rows_.offsets.to_numpy())
    if len(width) and (width != width[0]).any() or rows_.null_count:
        raise ValueError("rows of a dense matrix must be there and of one length")
    return rows_.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(rows_), -1).astype(float)


def _cells(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], ["i", "j", "v"])


def _tall_partials(pairs: DataFrame, upper: bool) -> DataFrame:
    """Cells of X^T Y over ``(x, y)`` rows: one dense partial product a task, so no cell of X meets the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = _dense(batch.column(0)), _dense(batch.column(1))
                product = x.T @ y
                total = product if total is None else total + product
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            keep = i <= j if upper else np.ones(len(i), bool)
            yield _cells(i[keep], j[keep], total.ravel()[keep])

    return pairs.select("x", "y").mapInArrow(partial, "i long, j long, v double")


def _width(rows_: DataFrame) -> int:
    first = rows_.select(F.size("row")).first()
    return first[0] if first else 0


def gemm_tall(a: DataFrame, b: DataFrame | None = None, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, mode: str = "WR_LAZY") -> DataFrame:
    """C <- alpha A^T B + beta C for tall A and B as ``(i, row)``; without ``b`` it is A^T A and nothing is joined.

    Each task sums one dense product of its rows; if that would have more than ``SMALL_CELLS`` cells, the product is :func:`gemm`'s.
    """
    if _width(a) * _width(a if b is None else b) > SMALL_CELLS:
        whole = cells(a, "i", "row")
        return gemm(whole, whole if b is None else cells(b, "i", "row"), c, alpha, beta, "T", "N", mode=mode)
    x = a.select("i", F.col("row").alias("x"))
    pairs = x.withColumn("y", F.col("x")) if b is None else x.join(b.select("i", F.col("row").alias("y")), "i")
    return _reduced(_tall_partials(pairs, False), c, alpha, beta, mode)


def syrk_tall(a: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The upper triangle of alpha A^T A for a tall A as ``(i, row)``."""
    if _width(a) ** 2 > SMALL_CELLS:
        return gemm_tall(a, alpha=alpha).where("i <= j")
    x = a.select(F.col("row").alias("x"), F.col("row").alias("y"))
    return _reduced(_tall_partials(x, True), None, alpha, 0.0, "WR_LAZY")


def gemm_blocked(a: DataFrame, b: DataFrame, size: int, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans_a: str = "N", trans_b: str = "N", mode: str = "WR_LAZY") -> DataFrame:
    """As :func:`gemm`, in boxes that hold whole tiles of ``size`` by ``size``."""
    return gemm(a, b, c, alpha, beta, trans_a, trans_b, plan={"T": size}, mode=mode)


def syrk(a: DataFrame, trans: str = "N", alpha: float = 1.0) -> DataFrame:
    """The upper triangle of alpha op(A) op(A)^T, as cells; for a tall A transposed there is :func:`syrk_tall`."""
    return gemm(a, a, None, alpha, 0.0, trans, "T" if trans == "N" else "N").where("i <= j")


def gemv(a: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans: str = "N", single: bool = False, plan: dict | None = None) -> DataFrame:
    """y <- alpha op(A) x + beta y."""
    a, x = _operand(a, single), _operand(x, single)
    joined = transposed(a, trans).join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").select("i", "j", (F.col("v") * F.col("w")).alias("v"))
    if plan and plan.get("T"):
        joined = joined.groupBy("i", F.expr(f"j div {int(plan['T'])}")).agg(F.sum("v").alias("v"))
    return _result(_plus(joined.groupBy("i").agg(F.sum("v").alias("v")), ["i"], y, alpha, beta, single), single)


def axpy(x: DataFrame, y: DataFrame, alpha: float, single: bool = False, plan: dict | None = None) -> DataFrame:
    """y <- alpha x + y, for every index that either has. Index by index, so a plan changes nothing."""
    w = _operand(x, single).select("i", F.col("v").alias("w"))
    total = _scalar(alpha, single) * F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))
    return _result(_operand(y, single).join(w, "i", "full").select("i", total.alias("v")), single)


def dot(x: DataFrame, y: DataFrame, init: float = 0.0, single: bool = False, plan: dict | None = None) -> DataFrame:
    """``init`` plus the inner product, as one row ``v``."""
    joined = _operand(x, single).join(_operand(y, single).select("i", F.col("v").alias("w")), "i").select("i", (F.col("v") * F.col("w")).alias("v"))
    if plan and plan.get("T"):
        joined = joined.groupBy(F.expr(f"i div {int(plan['T'])}")).agg(F.sum("v").alias("v"))
    return _result(joined.agg((_scalar(init, single) + F.coalesce(F.sum("v"), F.lit(0.0))).alias("v")), single)


def strided(vector: DataFrame, inc: int) -> DataFrame:
    """Every ``inc``-th entry, by logical index."""
    return vector.where(F.col("i") % inc == 0).select(F.expr(f"i div {inc}").alias("i"), "v")


def from_flat(vector: DataFrame, rows_: int, lead: int) -> DataFrame:
    """Cells of a column-major matrix stored flat with leading dimension ``lead``; rows past ``rows_`` are padding."""
    return vector.where(F.col("i") % lead < rows_).select((F.col("i") % lead).alias("i"), F.expr(f"i div {lead}").alias("j"), "v")


def fits(trans_a: Column, a_rows: Column, a_cols: Column, trans_b: Column, b_rows: Column, b_cols: Column, c_rows: Column, c_cols: Column) -> Column:
    """Whether op(A), op(B) and C have shapes that go together, for all flags; a flag other than N and T never does."""
    m, ka = F.when(trans_a == "N", a_rows).otherwise(a_cols), F.when(trans_a == "N", a_cols).otherwise(a_rows)
    kb, n = F.when(trans_b == "N", b_rows).otherwise(b_cols), F.when(trans_b == "N", b_cols).otherwise(b_rows)
    return F.coalesce(trans_a.isin("N", "T") & trans_b.isin("N", "T") & (ka == kb) & (m == c_rows) & (n == c_cols), F.lit(False))


def conforming(*shapes: Column) -> Column:
    """True if :func:`fits`; raises otherwise."""
    said = F.concat_ws(" ", *(x.cast("string") for x in shapes))
    return F.when(fits(*shapes), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("shapes or flags don't fit: "), said)).cast("boolean"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def task_grid(problems: DataFrame) -> DataFrame:
    """A row for each sub-kernel (mi, ni, ki) of ``(pid, M, N, K, T)``, numbered with ki fastest."""
    grid = problems.select("*", ceil_div(F.col("M"), F.col("T")).alias("gm"), ceil_div(F.col("N"), F.col("T")).alias("gn"), ceil_div(F.col("K"), F.col("T")).alias("gk"))
    each = grid.select("pid", "gn", "gk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gm") * F.col("gn") * F.col("gk") - 1)).alias("sk"))
    return each.select("pid", "sk", F.expr("sk div (gn * gk)").alias("mi"), F.expr("sk div gk % gn").alias("ni"), F.expr("sk % gk").alias("ki"))


def buffer_blocks(problems: DataFrame, lazy: bool = True) -> DataFrame:
    """Blocks of T x T doubles that a unit's buffer holds under ``cap`` bytes.

    ``(pid, needed, held, fits)``: what A, B and C need (C once more when it is fetched
    last), at most what the cap has room for; under 3 nothing can run.
    """
    gm, gn, gk = (ceil_div(F.col(d), F.col("T")) for d in "MNK")
    needed = gm * gk + gk * gn + gm * gn * (2 if lazy else 1)
    held = F.least(needed, F.floor(F.col("cap") / (8 * F.col("T") * F.col("T"))))
    return problems.select("pid", needed.alias("needed"), held.alias("held"), (held >= 3).alias("fits"))


def plan_reuse(calls: DataFrame, order: str, descriptor: list[str]) -> DataFrame:
    """Each call with the first one of its descriptor, whose plan it takes: ``planned_by``, and ``reuses``."""
    first = calls.groupBy(*descriptor).agg(F.min(order).alias("planned_by"))
    same = calls.alias("c").join(first.alias("f"), [F.col(f"c.{d}").eqNullSafe(F.col(f"f.{d}")) for d in descriptor])
    return same.select("c.*", "f.planned_by", (F.col(f"c.{order}") != F.col("f.planned_by")).alias("reuses"))


class PlanCache:
    """Plans by problem descriptor; when all places are taken, a new plan takes the first place."""

    def __init__(self, size: int = 100):
        self.size, self.places, self.plans = size, [], {}

    def get(self, descriptor: tuple, make):
        if descriptor not in self.plans:
            if len(self.places) < self.size:
                self.places.append(descriptor)
            else:
                del self.plans[self.places[0]]
                self.places[0] = descriptor
            self.plans[descriptor] = make()
        return self.plans[descriptor]
