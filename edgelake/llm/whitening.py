"""Whitening of embeddings with distributed block matrices.

Centred rows are indexed and cut into blocks; the product of the blocks' transpose with the blocks is the scatter
matrix, whose eigenvectors are found on the driver (it has the size of the dimension squared); rows are projected by a
product of their blocks with the whitening matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.positions import numbered
from edgelake.session import stored

COMPONENTS = 4
SCALE = 256
LEAST_BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
BLOCKS = 4096
PAIRS_PER_TASK = 8
RANK_LIMIT = 1e-12


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): entries times SCALE, floored, of the rows whose vector is there and has finite entries only.

    Vectors of another length than the most common one (of equally common lengths the longest) take no part.
    """
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    limit = F.lit(float("inf"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), entries.alias("v")).where(F.col("v").isNotNull() & finite)
    rows = stored(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return rows.where(F.size("x") == (top or 0))


def _blocks(rows: DataFrame, centre: np.ndarray, n: int) -> BlockMatrix:
    """Blocks of the rows (index, x) less the centre."""
    d = len(centre)
    height = int(np.clip(-(-n // BLOCKS), LEAST_BLOCK_ROWS, max(BLOCK_BYTES // (8 * d), LEAST_BLOCK_ROWS)))
    apart = F.zip_with("x", F.lit(centre), lambda x, c: x.cast("double") - c)
    indexed = rows.select("index", array_to_vector(apart).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), n, d).toBlockMatrix(height, d)


def _gram(blocks: BlockMatrix) -> np.ndarray:
    """The product of the transposed matrix with the matrix.

    The pairs of blocks are dealt over tasks by PAIRS_PER_TASK, and each task sends the sum of its products.
    """
    splits = max(1, -(-blocks.numRowBlocks // PAIRS_PER_TASK))
    turned = blocks.transpose()._java_matrix_wrapper
    product = turned.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _projected(blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    d, k = matrix.shape
    context = blocks.blocks.context
    whole = context.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel(order="F")))], 1)
    return blocks.multiply(BlockMatrix(whole, d, k))


@dataclass
class Whitening:
    """A fitted whitening: ``matrix`` has a column per component, for rows less ``sums`` / n."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors x of ``rows``, each counted once; None where there are no entries.

    Components with an eigenvalue of at most RANK_LIMIT of the trace are none. The sign of a component makes its largest
    entry positive.
    """
    distinct = numbered(rows.select("x").distinct(), "distinct", "index")
    n = distinct.count()
    totals = distinct.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect()
    if not totals:
        return None
    sums = np.zeros(len(totals), np.int64)
    for row in totals:
        sums[row["i"]] = row["s"]
    blocks = _blocks(distinct, sums / n, n)
    values, vectors = np.linalg.eigh(_gram(blocks) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(values.sum())
    kept = np.flatnonzero(values[:components] > RANK_LIMIT * trace)
    if not len(kept):
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])
    matrix = vectors / np.sqrt(values)
    left = _gram(_projected(blocks, matrix)) / n - np.eye(len(kept))
    return Whitening(n, sums, matrix, values / trace, float(np.abs(left).max()))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Every usable row on the leading whitened components: a row per row and component.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Rows without a vector, with null
    or non-finite entries, or of an uncommon length are left out; repeated rows count once in the fit and stay
    repeated in the result. Where all vectors are equal, and where there are none, no component is left and there
    are no rows. Other columns are not read.
    """
    rows = numbered(scaled(vectors, id_col, vector_col), "rows", "index")
    model = fit(rows, components)
    if model is None or not model.matrix.shape[1]:
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = _projected(_blocks(rows, model.sums / model.n, rows.count()), model.matrix)
    # The Python wrapper is kept until the call is over: with it goes the object in the JVM.
    matrix = blocks.toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", matrix._java_matrix_wrapper._java_model)
    placed = found.select(F.col("index"), F.posexplode(vector_to_array("vector")).alias("i", "whitened"))
    apart = F.zip_with("x", F.lit(model.sums), lambda x, s: x * F.lit(model.n).cast("bigint") - s)
    deviation = F.aggregate(apart, F.lit(0).cast("bigint"), lambda total, y: total + y * y)
    return rows.select("index", "vec_id", deviation.alias("deviation")).join(placed, "index").select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(model.explained), F.col("i")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
