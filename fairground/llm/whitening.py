"""Whitening of embeddings with MLlib's BlockMatrix.

Vectors become whole numbers, ``floor(64 * c) + 1000000``, and are centred on their exact mean.  The centred rows get
gapless numbers and are dealt into distributed blocks; the transposed blocks times the blocks give the scatter matrix,
whose middle dimension is split among tasks (``multiply``), so that no task gathers the rows.  The d x d scatter alone
comes to the driver (d is at most ``MAX_DIMENSIONS``); ``eigh`` gives components and eigenvalues there.  The blocks
times the whitening matrix (eigenvectors over roots of eigenvalues) project all rows.  The covariance of what comes out is
measured again over all rows, as the largest entry that differs from the identity's.

The driver holds, besides, one number a partition and one pair of numbers a block (MLlib plans its products by them).

Rows whose vector is null, or holds a null or an entry that isn't finite, have no result; so have vectors shorter than the
longest one, for they lack entries.  Rows with null ids and repeated rows are whitened like others, each on its own.
Components whose eigenvalue is zero to double precision are left out: a table of one vector, of equal vectors or an empty
table gives no rows.  Other columns, whatever their names, are not looked at.  A deviation that exceeds a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import cut, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A block of rows has at most so many bytes, and so many columns.
BLOCK_BYTES, BLOCK_COLUMNS = 2 << 20, 1024
#: The scatter matrix on the driver then has 512 MB.
MAX_DIMENSIONS = 8192
#: Row numbers within a partition are the lower bits of Spark's increasing ids.
IN_PARTITION = (1 << 33) - 1


@dataclass
class Whitening:
    """``rows``: (key, index, x); ``projected``: (index, z), one for each row; the rest is the fit."""

    rows: DataFrame
    projected: DataFrame | None
    n: int
    sums: list[int]
    explained: list[float]
    identity_error: float


def usable(vector: str) -> Column:
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), number)


def longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product, with the dimension that both share split among so many tasks for each block of the result."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def matrix(rows: DataFrame, values: Column, n: int, width: int) -> IndexedRowMatrix:
    """``rows``' index and array of doubles as a distributed matrix; nothing passes through Python."""
    vectors = rows.select("index", array_to_vector(values).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)


def numbered(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """((key, index, x) of the usable rows, their number, their width): indexes are gapless from 0."""
    found = vectors.where(usable(vector))
    width = found.agg(F.max(F.size(vector))).first()[0] or 0
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} entries: the scatter matrix would not fit on the driver")
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    found = found.where(F.size(vector) == width)
    rows = cut(found.select(F.col(key).alias("key"), x.alias("x"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(IN_PARTITION).alias("place")))
    begins, n = [], 0
    for part, count in sorted(map(tuple, rows.groupBy("part").count().collect())):
        begins.append((part, n))
        n += count
    begin = vectors.sparkSession.createDataFrame(begins, "part int, begin long")
    return rows.join(F.broadcast(begin), "part").select("key", (F.col("begin") + F.col("place")).alias("index"), "x"), n, width


def projected_rows(product: BlockMatrix, rows_per_block: int, width: int) -> DataFrame:
    """(index, z) from the blocks of a product that has one block a row of blocks."""
    m = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).select(F.col("_1._1").cast("long").alias("block"), F.unwrap_udt("_2").alias("m"))
    # A block's rows are made before they are dealt out, so that none of them takes the block along.
    at = f"if(m.isTransposed, row * {width} + c, c * m.numRows + row)"
    rows = F.expr(f"transform(sequence(0, m.numRows - 1), row -> transform(sequence(0, {width - 1}), c -> m.values[{at}]))")
    each = m.select("block", rows.alias("rows")).select("block", F.posexplode("rows").alias("row", "z"))
    return each.select((F.col("block") * rows_per_block + F.col("row")).alias("index"), "z")


def sums_of(rows: DataFrame, values: str, width: int) -> list:
    found = dict(map(tuple, rows.select(F.posexplode(values)).groupBy("pos").agg(F.sum("col")).collect()))
    return [found[i] for i in range(width)]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fit on all usable rows of ``vectors``, and all of them projected on the first ``components`` components."""
    rows, n, width = numbered(vectors, key, vector)
    if not n or not width:
        return Whitening(rows, None, n, [], [], 0.0)
    sums = [int(s) for s in sums_of(rows, "x", width)]
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    rows_per_block = max(1, min(BLOCK_BYTES // (8 * min(width, BLOCK_COLUMNS)), max(256, -(-n // parallel))))
    columns = min(width, BLOCK_COLUMNS)

    centred = F.zip_with("x", longs(sums), lambda x, s: (x * n - s).cast("double") / float(n))
    blocks = matrix(rows, centred, n, width).toBlockMatrix(rows_per_block, columns)
    halves = -(-n // rows_per_block) // 2 + 1  # about two blocks meet in a task
    scatter = multiply(blocks.transpose(), blocks, halves).toLocalMatrix().toArray()
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes = values[::-1], axes[:, ::-1]
    values = values[: min(components, int((values > width * np.finfo(float).eps * max(values[0], 0)).sum()))]
    k = len(values)
    if not k:
        return Whitening(rows, None, n, sums, [], 0.0)

    weights = axes[:, :k] / np.sqrt(values)
    parts = [((i, 0), DenseMatrix(len(w := weights[a : a + columns]), k, w.ravel(order="F"))) for i, a in enumerate(range(0, width, columns))]
    right = BlockMatrix(vectors.sparkSession.sparkContext.parallelize(parts, 1), columns, k, width, k)
    projected = cut(projected_rows(multiply(blocks, right), rows_per_block, k))

    means = F.array(*(F.lit(float(s) / n) for s in sums_of(projected, "z", k)))
    gram = matrix(projected, F.zip_with("z", means, lambda z, m: z - m), n, k).computeGramianMatrix().toArray()
    trace = float(np.trace(scatter)) / n
    return Whitening(rows, projected, n, sums, [float(v / trace) for v in values], float(np.abs(gram / n - np.eye(k)).max()))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = whiten(table(spark, sf_dir, "embeddings"))
    if fit.projected is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    apart = F.zip_with("x", longs(fit.sums), lambda x, s: F.try_multiply(x * fit.n - s, x * fit.n - s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), F.try_add)
    both = fit.rows.select("index", F.col("key").alias("vec_id"), deviation.alias("deviation")).join(fit.projected, "index")
    explained = F.array(*map(F.lit, fit.explained))
    each = both.select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
