"""Whitening of embeddings through distributed block matrices.

Every entry of a vector becomes a whole number, x = floor(scale * entry) + shift, so that
sums over any number of rows are exact. The centred rows x - S / n are numbered and cut into
the blocks of a ``BlockMatrix`` A; the scatter A'A is a product of block matrices, whose
middle dimension is dealt out over ``splits`` tasks for each block of the result, so that no
task gathers all rows. The covariance, as wide as a vector, is factored on the driver, and
the rows are projected by the product of A with the whitening matrix, a block matrix too.

Defined cases. Rows whose vector is null, holds null, NaN or infinite entries, or is shorter
than the longest vector (its last entries are missing) are dropped; so are entries whose x
is not a whole double (beyond 2 ** 53). Repeated rows and equal ids count as often as they
stand there. Null ids are kept. A component whose variance is nothing but rounding (below
``dims * 2 ** -52`` of the largest) cannot be whitened: its ``whitened`` is null, and the
error of the identity is taken over the others. A deviation beyond a long is null. Without
rows there is no result row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block: 512 KB at 64 entries.
BLOCK_ROWS = 1024
#: Columns of a block; a vector with more entries lies across several blocks.
BLOCK_COLS = 1024
#: Blocks of the middle dimension that one task of a product adds up, at least.
BLOCKS_A_SPLIT = 8
_WHOLE = float(2**53)


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """x of every entry as longs; null where an entry is null, not finite or too large."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)) + F.lit(0.0)))
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * float(scale)) < _WHOLE, F.lit(False)))
    return F.when(fit, F.transform(scaled, lambda c: c + F.lit(shift).cast("long")))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``index`` from 0 on, without gaps; one count for each partition is
    gathered to place them one after another."""
    rows = stored(df.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    held = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in held], dtype=np.int64)])
    first = [(r["part"], int(s)) for r, s in zip(held, starts)]
    first = df.sparkSession.createDataFrame(first, "part long, start long")
    rows = rows.withColumn("part", part).join(F.broadcast(first), "part")
    return rows.withColumn("index", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place", "part", "start")


def blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """The block matrix of ``index, vector`` (an array of doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLS, dims))


def scatter(a: BlockMatrix) -> np.ndarray:
    """A'A. Python's ``multiply`` has no argument for the number of parts that the rows
    are added up in, so the product is called where it has."""
    splits = max(1, -(-a.numRows() // a.rowsPerBlock) // BLOCKS_A_SPLIT)
    t = a.transpose()
    made = t._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, t.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def project(a: BlockMatrix, w: np.ndarray) -> BlockMatrix:
    """A times the matrix ``w``, which has as few entries as a block's columns by components."""
    sc = a.blocks.context
    high = a.colsPerBlock
    parts = [((k, 0), w[high * k : high * (k + 1)]) for k in range(-(-len(w) // high))]
    made = [(at, DenseMatrix(len(p), p.shape[1], p.ravel(order="F"))) for at, p in parts]
    return a.multiply(BlockMatrix(sc.parallelize(made, len(made)), high, w.shape[1], len(w), w.shape[1]))


def rows_of(a: BlockMatrix) -> DataFrame:
    """``index, vector`` of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    ml = MLUtils.convertVectorColumnsToML(rows, "vector")
    return ml.select("index", vector_to_array("vector").alias("vector"))


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error`` for every row kept of
    ``vec_id, embedding``: whitened and explained are arrays over the components."""
    spark = df.sparkSession
    rows = df.select("vec_id", whole(F.col("embedding"), scale, shift).alias("x"))
    rows = rows.where("size(x) > 0")
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    schema = "vec_id {}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if longest is None:
        return spark.createDataFrame([], schema.format(df.schema["vec_id"].dataType.simpleString()))
    rows = numbered(rows.where(F.size("x") == longest), "whole-vectors")

    at = rows.select(F.posexplode("x").alias("dim", "c"))
    sums = at.groupBy("dim").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("dim").collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]  # as many as a vector has entries
    fits = all(abs(v) < 2**63 for v in s)
    exact = F.array(*[F.lit(v if fits else None).cast("long") for v in s])
    near = F.array(*[F.lit(float(v) / n) for v in s])
    # n * x - S in longs, and where that overflows null
    gap = F.zip_with("x", exact, lambda x, v: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), v))
    add = F.aggregate("gap", F.lit(0).cast("long"), lambda a, g: F.try_add(a, F.try_multiply(g, g)))
    mean = F.zip_with("x", near, lambda x, v: x - v)
    centred = F.transform(F.arrays_zip("gap", mean.alias("m")), lambda z: F.coalesce(z["gap"].cast("double") / n, z["m"]))
    rows = rows.withColumn("gap", gap).select("index", "vec_id", add.alias("deviation"), centred.alias("vector"))
    rows = stored(rows, "centred-vectors")

    a = blocks(rows, n, longest)
    cov = scatter(a) / n
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    top = np.argsort(-e, kind="stable")[:components]
    total, e, v = float(np.trace(cov)), e[top], v[:, top]
    live = e > max(e[0], 0.0) * longest * 2.0**-52
    w = v[:, live] / np.sqrt(e[live])
    explained = [float(max(x, 0.0) / total) if total > 0 else 0.0 for x in e]
    if live.any():
        spread = stored(rows_of(project(a, w)), "whitened-vectors")
        error = identity_error(spread, n, int(live.sum()))
    else:
        spread, error = rows.select("index", F.array().cast("array<double>").alias("vector")), 0.0
    place = np.cumsum(live) - 1
    full = F.array(*[F.get("vector", F.lit(int(p))) if ok else F.lit(None).cast("double") for p, ok in zip(place, live)])
    spread = spread.select("index", full.alias("whitened"))
    return rows.select("index", "vec_id", "deviation").join(spread, "index").select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(x) for x in explained]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(spread: DataFrame, n: int, dims: int) -> float:
    """Largest absolute entry of the covariance of ``index, vector`` less the identity."""
    parts = spread.select(F.posexplode("vector").alias("dim", "c")).groupBy("dim").agg(F.avg("c").alias("m")).orderBy("dim")
    means = F.array(*[F.lit(r["m"]) for r in parts.collect()])
    centred = spread.select("index", F.zip_with("vector", means, lambda c, m: c - m).alias("vector"))
    cov = scatter(blocks(centred, n, dims)) / n
    return float(np.abs(cov - np.eye(dims)).max())
