"""Embedding whitening with MLlib block matrices.

Entries become whole numbers x = floor(1024 c) + 100000.  The rows, centred by the exact mean of
each dimension, are indexed into a distributed ``BlockMatrix``; its transpose times itself is the
scatter, summed over slabs of ``SLAB`` row blocks so that no task gets more than a slab.  Only the
d x d scatter reaches the driver, where ``eigh`` gives components and eigenvalues; the whitening
matrix (components over the roots of their eigenvalues) is a second block matrix, and a block
product projects all rows.  The identity error is measured on the projected rows themselves.

At the driver: the scatter (d^2 numbers), and the coordinates of the blocks, one per ``BLOCK``
numbers of the input, which ``BlockMatrix.multiply`` plans with.  Rows get their index from the
partition of a written table and their place in it, so nothing is sorted and a lost executor
repeats the same numbers.

Defined results: rows with a null vector, a null, NaN or infinite entry, or fewer entries than the
longest vector are dropped; repeated rows and ids stay and count each; a null id is passed on.
``deviation`` is null where it exceeds a long, ``deviation_decimal`` holds it then.  A component
without variance (up to rounding) has a null ``whitened`` and stays out of ``identity_error``; without
any variance ``explained`` is null.  An empty table gives no rows.  Only the id and the vector are
read, so other columns may have any name.  Entries are expected below 2^40 in size.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.staging import stage

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
BLOCK = 1 << 18  # numbers in a block
SLAB = 8  # row blocks multiplied in one task
FLAT = 1e-12  # share of the trace below which an eigenvalue is rounding


@dataclass
class Fit:
    n: int
    sums: list[int]  # of x, by dimension
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # its unit eigenvectors, as columns

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    @property
    def spread(self) -> np.ndarray:
        """Whether a component has variance."""
        return self.values > FLAT * max(self.values.sum(), 0.0)


def whole_numbers(embeddings: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """id, x, part, place: the rows that stay, written, with what their index is made of."""
    value = F.col(vector)
    sound = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(value, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    rows = embeddings.select(F.col(id_column).alias("id"), F.when(sound, whole).alias("x"))
    return stage(
        rows.where(F.size("x") > 0).select(
            "id", "x", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        ),
        "whole_numbers",
    )


def indexed(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Rows of ``width`` entries with a contiguous-enough ``index``, and its upper bound.

    One offset per partition of the written table: a handful of numbers per task.
    """
    ends = rows.groupBy("part").agg((F.max("place") + 1).alias("size")).orderBy("part").collect()
    offsets, total = [], 0
    for row in ends:
        offsets.append((row["part"], total))
        total += row["size"]
    table = rows.sparkSession.createDataFrame(offsets, "at_part int, offset long")
    out = rows.where(F.size("x") == width).join(F.broadcast(table), F.col("part") == F.col("at_part"))
    return out.select("id", "x", (F.col("offset") + F.col("place")).alias("index")), total


def totals(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""
    sums = (
        rows.where(F.size("x") == width).select(F.posexplode("x").alias("dim", "v"))
        .groupBy("dim").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("dim").collect()
    )
    return sums[0]["n"], [r["s"] for r in sums]


def centred_blocks(rows: DataFrame, mean: list[float], total: int) -> BlockMatrix:
    """The rows minus ``mean`` as a block matrix, built and kept in the JVM."""
    width = len(mean)
    centred = F.zip_with("x", F.lit(mean), lambda x, m: x.cast("double") - m)
    table = rows.select("index", array_to_vector(centred).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(table, "vector"), total, width)
    columns = min(width, 1024)
    return matrix.toBlockMatrix(max(1, BLOCK // columns), columns)


def product(left: BlockMatrix, right: BlockMatrix, slabs: int) -> BlockMatrix:
    """``left`` times ``right`` with the inner dimension in ``slabs`` parts.

    The JVM method takes the number of parts; its Python wrapper does not pass it on.
    """
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, slabs)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def fit(blocks: BlockMatrix, n: int, sums: list[int]) -> Fit:
    slabs = max(1, -(-blocks.numRows() // (blocks.rowsPerBlock * SLAB)))
    scatter = product(blocks.transpose(), blocks, slabs).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    return Fit(n, sums, values[::-1], vectors[:, ::-1])


def project(spark: SparkSession, blocks: BlockMatrix, model: Fit, components: int) -> DataFrame:
    """index, z: the centred rows times the whitening matrix."""
    spread = model.spread[:components]
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, model.values[:components], 1.0)), 0.0)
    whitening = model.vectors[:, :components] * scale
    height, k = blocks.colsPerBlock, whitening.shape[1]
    pieces = []
    for i, at in enumerate(range(0, len(whitening), height)):
        part = whitening[at : at + height]
        pieces.append(((i, 0), DenseMatrix(len(part), k, part.ravel(order="F").tolist())))
    right = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), height, k, len(whitening), k)
    rows = blocks.multiply(right).toIndexedRowMatrix()
    table = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(table, "vector").select("index", vector_to_array("vector").alias("z"))


def identity_error(projected: DataFrame, n: int, used: int) -> float | None:
    """Largest entry of the covariance of ``z`` minus the identity, over its first ``used`` entries."""
    if used == 0:
        return None
    z = [F.get("z", i) for i in range(used)]
    means = projected.agg(*[(F.sum(c) / n).alias(f"m{i}") for i, c in enumerate(z)]).first()
    off = [c - F.lit(float(m)) for c, m in zip(z, means)]
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    cov = projected.agg(*[(F.sum(off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, cov))


def deviation(x: str, sums: list[int], n: int) -> Column:
    """sum (n x - S)^2, exactly: with x = m + y and S = n m + r it is n^2 yy - 2 n yr + rr."""
    base = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, base)]
    y = F.zip_with(x, F.lit(base), lambda v, m: v - m)
    zero = F.lit(0).cast("long")
    squares = F.aggregate(y, zero, lambda total, v: total + v * v)
    mixed = F.aggregate(F.zip_with(y, F.lit(rest), lambda v, r: v * r), zero, lambda total, v: total + v)
    exact = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    return (
        exact(n * n) * squares.cast("decimal(38,0)") - exact(2 * n) * mixed.cast("decimal(38,0)")
        + exact(sum(r * r for r in rest))
    ).cast("decimal(38,0)")


EMPTY = "n long, deviation long, whitened double, explained double, identity_error double, deviation_decimal decimal(38,0)"


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", id_column: str = "vec_id"
) -> DataFrame:
    """One row per kept vector and component."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings, vector, id_column)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        kind = embeddings.schema[id_column].dataType.simpleString()
        return spark.createDataFrame([], f"{id_column} {kind}, component int, {EMPTY}")
    n, sums = totals(rows, width)
    numbered, total = indexed(rows, width)
    blocks = centred_blocks(numbered, [s / n for s in sums], total)
    model = fit(blocks, n, sums)
    k = min(components, width)
    projected = stage(project(spark, blocks, model, k), "whitened")
    # Rows without an index of their own (dropped for their length) are all zero and join nothing.
    used = int(model.spread[:k].sum())
    kept = projected.join(numbered.select("index"), "index", "left_semi") if total > n else projected
    error = identity_error(kept, n, used)
    trace = float(model.values.sum())
    share = [float(v) / trace if trace > 0 else None for v in model.values[:k]]
    exact = deviation("x", sums, n)
    out = numbered.select("id", "index", exact.alias("deviation_decimal")).join(projected, "index").select(
        "id", "deviation_decimal", F.posexplode("z").alias("at", "value")
    )
    return out.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("deviation_decimal").try_cast("bigint").alias("deviation"),
        F.when(F.col("at") < used, F.col("value")).alias("whitened"),
        F.get(F.lit(share).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_decimal",
    )
