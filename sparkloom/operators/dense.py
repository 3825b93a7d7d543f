"""Wide and large matrices: trees of small factors, range finders, merged moments, block elimination.

Rows of a table are arrays.  What the tasks pass on are small matrices, combined level by
level: each level is an exchange, so every partition is read by a task of its own.  Only
results whose size a parameter bounds come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl
from sparkloom.functions.vector import dot
from sparkloom.sources.shared import drop, stored

ROWS = pa.schema([("i", pa.int32()), ("x", pa.list_(pa.float64()))])


def as_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x``: the columns as an array, a null as 0."""
    return df.select(F.array(*[F.coalesce(dbl(F.col(c)), F.lit(0.0)) for c in columns]).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The arrays of a batch; all must have ``d`` entries, and null entries are 0."""
    x = batch.column("x")
    if x.null_count or (x.value_lengths().to_numpy() != d).any():
        raise ValueError(f"arrays of {d} numbers are wanted")
    flat = x.flatten()
    return (flat.fill_null(0.0) if flat.null_count else flat).to_numpy().reshape(-1, d)


def tree(rows: DataFrame, d: int, first: Callable, join: Callable, fan: int = 32) -> DataFrame:
    """``i, x``: matrices of the partitions of ``rows`` (arrays ``x`` of ``d`` numbers), combined ``fan`` at a time.

    ``first(matrix or None, rows)`` takes in rows; ``join(matrix or None, i, rows)`` rows of earlier matrices.
    """

    def run(step, width):
        def inner(batches):
            held = None
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, width or len(batch.column("x")[0]))
                    held = step(held, x) if step is first else step(held, batch.column("i").to_numpy(), x)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(list(held), pa.list_(pa.float64()))], schema=ROWS)

        return inner

    n = max(1, rows.rdd.getNumPartitions())
    out = rows.select("x").mapInArrow(run(first, d), "i int, x array<double>")
    while n > 1:
        n = -(-n // fan)
        out = out.repartition(n).mapInArrow(run(join, None), "i int, x array<double>")
    return out


def _collected(out: DataFrame, width: int) -> np.ndarray:
    """The matrix a tree ends in: as many rows as its parameters say."""
    found = {r["i"]: r["x"] for r in out.collect()}
    return np.array([found[i] for i in sorted(found)]).reshape(-1, width)


def _triangle(held, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x if held is None else np.concatenate([held, x]), mode="r")


def triangle(rows: DataFrame, d: int, of: Callable | None = None) -> np.ndarray:
    """R of the reduced QR of the rows (or of ``of`` them) by a tree; its diagonal is not negative."""
    out = tree(rows, d, lambda held, x: _triangle(held, of(x) if of else x), lambda held, i, x: _triangle(held, x))
    r = np.array([r["x"] for r in sorted(out.collect(), key=lambda r: r["i"])])  # d rows at most
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.size else np.zeros((0, d))


def _added(held, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows added to those of the same number (rows of a matrix can come in any order)."""
    size = max(int(i.max()) + 1, 0 if held is None else len(held))
    out = np.zeros((size, x.shape[1]))
    if held is not None:
        out[: len(held)] = held
    np.add.at(out, i, x)
    return out


def _moments(held, x: np.ndarray) -> np.ndarray:
    one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    return one.T @ one if held is None else held + one.T @ one


def moments(rows: DataFrame, d: int) -> DataFrame:
    """``i, x``: the ``d`` + 1 rows of the products of (1, row) with itself: count, sums, sums of products."""
    return tree(rows, d, _moments, _added)


# Singular values of wide tables


@dataclass
class Wide:
    """Leading singular values and right vectors (rows), the mean that was taken off, and the rows."""

    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    n: int

    def scores(self, x: Column) -> Column:
        """The coordinates of an array along the vectors."""
        centred = F.zip_with(x, F.lit(self.mean.tolist()), lambda a, m: dbl(a) - m)
        return F.array(*[dot(centred, F.lit(v.tolist())) for v in self.vectors])


def wide_svd(rows: DataFrame, d: int, k: int, centre: bool = False, more: int = 10, rounds: int = 4, seed: int = 0) -> Wide:
    """The first ``k`` singular values of rows ``x`` of ``d`` numbers, by a random range finder.

    ``k + more`` random directions are turned ``rounds`` times towards the leading ones: each round is one
    pass that adds up ``x.T (x V)`` in blocks, and none follows once the span stays the same.  The values come from the tree QR of ``x V``, so they are not
    squared.  What a task passes on and the driver holds is ``d`` times ``k + more`` numbers; with ``k + more >= d`` the result is exact.
    """
    width = min(k + more, d)
    if centre:
        first = _collected(tree(rows, d, lambda held, x: np.concatenate([[len(x)], x.sum(axis=0)])[None, :] + (0 if held is None else held), _added), d + 1)
        n = int(first[0, 0]) if len(first) else 0
        mean = first[0, 1:] / max(n, 1) if len(first) else np.zeros(d)
    else:
        n, mean = rows.count(), np.zeros(d)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(rounds if width < d else 1):
        turned = _collected(tree(rows, d, lambda held, x, v=v: (x - mean).T @ ((x - mean) @ v) + (0 if held is None else held), _added), width)
        if not len(turned) or not turned.any():
            break
        settled = np.linalg.norm(turned - v @ (v.T @ turned)) <= 1e-14 * np.linalg.norm(turned)
        v = np.linalg.qr(turned)[0]
        if settled:  # the directions span what they are turned to: more rounds would give the same span
            break
    r = triangle(rows, d, lambda x: (x - mean) @ v)
    if not len(r):
        return Wide(np.zeros(0), np.zeros((0, d)), mean, n)
    _, values, w = np.linalg.svd(r, full_matrices=False)
    vectors = w @ v.T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return Wide(values[:k], (vectors * np.where(sign == 0, 1, sign)[:, None])[:k], mean, n)


# Moments that grow batch by batch


class Moments:
    """Counts, sums and sums of products of named columns, one stored matrix for each batch.

    A batch is read once.  It stands under its own number, so a batch that comes again (a
    stream that restarts) takes its place instead of counting twice.  Models are fitted to the sum of
    the stored matrices without the rows: ``len(columns) + 1`` squared numbers a batch.
    """

    def __init__(self, spark: SparkSession, columns: list[str], path: str):
        self.spark, self.columns, self.path = spark, list(columns), path.rstrip("/")

    def add(self, batch: DataFrame, number: int) -> None:
        """Also as ``foreachBatch(moments.add)``."""
        cells = moments(as_rows(batch, self.columns), len(self.columns))
        cells.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={int(number)}")

    def table(self) -> DataFrame:
        """``i, j, v``: the sum of all batches; row and column 0 are counts and sums."""
        each = self.spark.read.schema("i int, x array<double>, batch long").parquet(self.path)
        return each.select("i", F.posexplode("x").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))

    def merged(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Count, sums and products."""
        m = np.zeros((len(self.columns) + 1,) * 2)
        for r in self.table().collect():  # a cell for each two columns
            m[r["i"], r["j"]] = r["v"]
        return int(m[0, 0]), m[0, 1:], m[1:, 1:]

    def covariance(self) -> DataFrame:
        """``a, b, v``: sample covariances."""
        n, s, g = self.merged()
        c = (g - np.outer(s, s) / max(n, 1)) / max(n - 1, 1)
        cells = [(a, b, float(c[i, j])) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns)]
        return self.spark.createDataFrame(cells, "a string, b string, v double")


# Large linear systems


BLOCK = "bi int, bj int, m binary"


def _blocks_of(cells: DataFrame, rows: int, columns: int, size: int, shift: int = 0, pad: bool = False) -> DataFrame:
    """``bi, bj, m`` of a matrix of cells ``i, j, v``: dense blocks of ``size``, absent cells 0, and 1 on the diagonal beyond the edge (``pad``)."""
    spark, down, across = cells.sparkSession, -(-rows // size), -(-columns // size)
    inside = cells.where(F.col("i").between(0, rows - 1) & F.col("j").between(0, columns - 1))
    summed = inside.groupBy("i", "j").agg(F.sum(dbl(F.col("v"))).alias("v"))
    at = (F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"))
    held = summed.groupBy(*at).agg(F.collect_list(F.struct(((F.col("i") % size) * size + F.col("j") % size).cast("int").alias("at"), "v")).alias("cells"))  # size squared at most
    all_ = spark.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("bi"), (F.col("id") % across).cast("int").alias("bj"))

    def run(batches):
        for batch in batches:
            out = []
            for bi, bj, some in zip(*(batch.column(c) for c in ("bi", "bj", "cells"))):
                m = np.zeros(size * size)
                if some.is_valid:
                    flat = some.values
                    m[flat.field("at").to_numpy()] = flat.field("v").to_numpy()
                if pad and bi.as_py() == bj.as_py():
                    over = np.arange(max(0, rows - bi.as_py() * size), size)
                    m[over * size + over] = 1.0
                out.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bi"), pa.array([x.as_py() + shift for x in batch.column("bj")], pa.int32()), pa.array(out, pa.binary())], names=["bi", "bj", "m"])

    return all_.join(held, ["bi", "bj"], "left").mapInArrow(run, BLOCK)


def _each(df: DataFrame, size: int, fn: Callable[..., np.ndarray], *matrices: str) -> DataFrame:
    """``bi, bj, m`` with ``m`` the function of some blocks of the row."""

    def run(batches):
        for batch in batches:
            out = [fn(*(np.frombuffer(x, dtype=float).reshape(size, size) for x in some)).tobytes() for some in zip(*(batch.column(c).to_pylist() for c in matrices))]
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), pa.array(out, pa.binary())], names=["bi", "bj", "m"])

    return df.mapInArrow(run, BLOCK)


def _pivots(column: DataFrame, size: int) -> list:
    """Least singular value, sign and logarithm of the determinant of each block of a column of blocks."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("m").to_pylist():
                m = np.frombuffer(x, dtype=float).reshape(size, size)
                rows.append((float(np.linalg.svd(m, compute_uv=False)[-1]), *map(float, np.linalg.slogdet(m))))
            yield pa.RecordBatch.from_arrays([batch.column("bi"), *(pa.array(c, pa.float64()) for c in (zip(*rows) if rows else ([],) * 3))], names=["bi", "least", "sign", "log"])

    return column.select("bi", "m").mapInArrow(run, "bi int, least double, sign double, log double").collect()


def _eliminated(a: DataFrame, n: int, right: DataFrame | None, columns: int, size: int) -> tuple[DataFrame, list[int], float, float]:
    """Gauss-Jordan by blocks: the blocks right of the matrix, the row block that solved each column block, and sign and logarithm of the determinant.

    The pivot of a step is the block, among the rows not yet used, that is farthest from singular.  A step joins the blocks that remain with those of the pivot's column
    (by row) and of its row (by column), each a product in a task; the next one reads what it wrote.
    """
    spark, many = a.sparkSession, -(-n // size)
    now = _blocks_of(a, n, n, size, pad=True)
    if right is not None:
        now = now.unionByName(_blocks_of(right, n, columns, size, shift=many))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now, used, sign, log = stored(now, "blocks"), [], 1.0, 0.0
    for k in range(many):
        column = now.where(F.col("bj") == k)
        open_ = [r for r in _pivots(column, size) if r["bi"] not in used]  # a row for each block of a column
        best = max(open_, key=lambda r: (r["least"], -r["bi"]))
        if not best["least"] > 0:
            raise ValueError("the matrix is singular")
        p, sign, log = best["bi"], sign * best["sign"], log + best["log"]
        used.append(p)
        rest = now.where(F.col("bj") > k)
        pivot = column.where(F.col("bi") == p).select("bi", F.col("m").alias("p"))
        row = _each(rest.join(pivot, "bi"), size, lambda m, q: np.linalg.solve(q, m), "m", "p")
        row = stored(row, "blocks")
        left, over = column.select("bi", F.col("m").alias("c")), row.select("bj", F.col("m").alias("r"))
        others = rest.where(F.col("bi") != p).repartition(parts, "bi", "bj").join(left, "bi").join(over, "bj")
        new = stored(row.unionByName(_each(others, size, lambda m, c, r: m - c @ r, "m", "c", "r")), "blocks")
        drop(now)
        drop(row)
        now = new
    swaps = sum(x > y for i, x in enumerate(used) for y in used[i + 1 :]) * size
    return now, used, sign * (-1.0) ** swaps, log


def _cells(blocks: DataFrame, used: list[int], size: int, rows: int, columns: int) -> DataFrame:
    """``i, j, v`` of the blocks right of the matrix, with rows in the order of the unknowns."""
    many, place = len(used), {p: k for k, p in enumerate(used)}

    def run(batches):
        for batch in batches:
            for bi, bj, m in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "m"))):
                i, j = np.divmod(np.arange(size * size), size)
                i, j, v = i + place[bi] * size, j + (bj - many) * size, np.frombuffer(m, dtype=float)
                some = (i < rows) & (j < columns)
                yield pa.RecordBatch.from_arrays([pa.array(i[some]), pa.array(j[some]), pa.array(v[some])], names=["i", "j", "v"])

    return blocks.mapInArrow(run, "i long, j long, v double")


def solve_large(a: DataFrame, b: DataFrame, n: int, size: int = 256) -> DataFrame:
    """``i, v``: the solution of one large system; ``a`` has rows ``i, j, v`` and ``b`` rows ``i, v``, absent ones 0."""
    blocks, used, _, _ = _eliminated(a, n, b.select("i", F.lit(0).cast("long").alias("j"), "v"), 1, size)
    return _cells(blocks, used, size, n, 1).select("i", "v")


def solve_bordered(a: DataFrame, b: DataFrame, n: int, border: int, size: int = 256) -> DataFrame:
    """``i, v`` for ``i < n``: the solution of a system whose first ``n`` unknowns meet only in diagonal blocks of ``size``, all else in ``border`` last rows and columns.

    ``a`` has rows ``i, j, v`` with numbers below ``n + border``, ``b`` rows ``i, v``; absent ones are 0 and cells given twice are added.  A diagonal plus a product
    ``u w'`` of ``border`` columns is such a system of few cells: its border holds ``u``, ``w'`` and minus the unit matrix.  Each block is eliminated by a task with the
    cells of its rows and columns alone; what the blocks add up to, and the driver solves, is ``border`` squared numbers.
    A cell between two blocks, or a singular block or rest, is an error.
    """
    if border < 1:
        raise ValueError("a border of one or more is wanted")
    inside = a.where(F.col("i").between(0, n + border - 1) & F.col("j").between(0, n + border - 1)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), dbl(F.col("v")).alias("v"))
    right = b.where(F.col("i").between(0, n + border - 1)).select(F.col("i").cast("long").alias("i"), F.lit(n + border).cast("long").alias("j"), dbl(F.col("v")).alias("v"))
    both = inside.unionByName(right).unionByName(a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")))  # each block is met
    corner, most = np.zeros((border, border + 1)), n + border
    in_block = F.least("i", "j") < n
    for r in both.where(~in_block).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # border squared at most
        corner[r["i"] - n, r["j"] - n] = r["v"]
    cells = both.where(in_block).withColumn("block", F.floor(F.when(F.col("i") < n, F.col("i")).otherwise(F.col("j")) / size).cast("long"))

    def run(key, t):
        first = int(key[0]) * size
        width = min(size, n - first)
        m = np.zeros((width + border, width + border + 1))
        i, j = (np.where(x >= n, x - n + width, x - first) for x in (t["i"].to_numpy(), t["j"].to_numpy()))
        if (i < 0).any() or (j < 0).any() or ((t["j"].to_numpy() < n) & (j >= width)).any():
            raise ValueError("a cell lies between two blocks")
        np.add.at(m, (i, j), t["v"].to_numpy())
        solved = np.linalg.solve(m[:width, :width], m[:width, width:])  # of the border's columns and the right side
        rest = m[width:, :width] @ solved
        out = [(first + k, x.tolist()) for k, x in enumerate(solved)] + [(most + k, x.tolist()) for k, x in enumerate(rest)]
        return pa.Table.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=["i", "x"])

    done = stored(cells.groupBy("block").applyInArrow(run, "i long, x array<double>"), "bordered")
    sums = done.where(F.col("i") >= most).select("i", F.posexplode("x").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # border squared at most
        corner[r["i"] - most, r["j"]] -= r["v"]
    last = np.linalg.solve(corner[:, :border], corner[:, border])
    return done.where(F.col("i") < most).select("i", (F.element_at("x", border + 1) - dot(F.slice("x", 1, border), F.lit(last.tolist()))).alias("v"))


def inverse_large(a: DataFrame, n: int, size: int = 256) -> DataFrame:
    """``i, j, v`` of the inverse of one large matrix."""
    one = a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    blocks, used, _, _ = _eliminated(a, n, one, n, size)
    return _cells(blocks, used, size, n, n)


def log_det_large(a: DataFrame, n: int, size: int = 256) -> tuple[float, float]:
    """Sign and logarithm of the absolute value of the determinant of one large matrix."""
    try:
        return _eliminated(a, n, None, 0, size)[2:]
    except ValueError:
        return 0.0, float("-inf")
