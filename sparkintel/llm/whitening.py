"""Whitening of embeddings with MLlib's distributed block matrices.

Rows are numbered without gaps, centred, and laid out as blocks of rows. The transpose times the matrix
is the scatter, whose eigenvectors are found on the driver, as it is as large as the square of the dimension
and no larger with more rows; the matrix times the scaled eigenvectors gives the whitened rows.

A block matrix keeps the numbers of its blocks on the driver, so that rows are taken in slabs of at most
SLAB_ROWS, each a matrix of its own: scatters add up, and rows are projected slab by slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
BLOCK_ROWS = 1024
SLAB_ROWS = 1 << 27
#: Blocks of rows that one task of a product takes.
_BLOCKS_A_TASK = 16
#: A component is whitened if its variance is more than this share of the trace.
_LEAST_SHARE = 1e-12


def _numbered(rows: DataFrame, staged: Staged) -> tuple[DataFrame, int]:
    """rows, which are as written, with a number each from 0 without gaps, and how many there are.

    Rows are counted by the partition that reads them, and the starts of partitions, one row a file or
    slice of a file, go to all tasks.
    """
    marked = staged.write(rows.withColumn("mark", F.monotonically_increasing_id()))
    counts = sorted((r["part"], r["n"]) for r in marked.groupBy(F.expr("shiftright(mark, 33)").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    places = rows.sparkSession.createDataFrame(starts, "part long, start long")
    within = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = marked.withColumn("part", F.expr("shiftright(mark, 33)")).join(F.broadcast(places), "part")
    return numbered.withColumn("number", F.col("start") + within).drop("part", "start", "mark"), total


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by dimension of a column of equally long lists, one row a batch and dimension."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(axis=0, dtype=np.int64))], names=["place", "part"])


def _centred(n: int, sums: list[int]):
    """number, vector (x - S/n) and deviation (sum of (n*x - S)^2, null beyond 64 bits) of rows of x."""
    own = np.array(sums, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(sums))
            apart = n * x - own
            deviation = (apart * apart).sum(axis=1)
            near = (apart.astype(float) ** 2).sum(axis=1) < 2.0**62
            if not near.all():
                exact = [sum(v * v for v in row) for row in apart[~near].tolist()]
                deviation = deviation.astype(object)
                deviation[~near] = [v if v < 1 << 63 else None for v in exact]
            offsets = pa.array(np.arange(0, x.size + 1, len(sums), dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array((apart / n).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(deviation.tolist(), pa.int64())], names=["number", "vector", "deviation"])

    return work


def _slabs(rows: DataFrame, n: int, slab_rows: int) -> Iterator[tuple[DataFrame, int]]:
    """Rows by ranges of their numbers, numbered from 0 in each, and the first number of the range."""
    for first in range(0, n, slab_rows):
        yield rows.where(F.col("number").between(first, first + slab_rows - 1)), first


def _blocks(slab: DataFrame, first: int, width: int, block_rows: int) -> BlockMatrix:
    """The column `vector` (an array of doubles) as blocks of rows."""
    vectors = slab.select((F.col("number") - first).alias("index"), array_to_vector("vector").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(block_rows, width)


def scatter(rows: DataFrame, n: int, width: int, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Sum over rows (number from 0, vector) of the vector's products with itself, by block matrices.

    The inner dimension is split, so that a task multiplies a few blocks, whose small products are added up.
    """
    total = np.zeros((width, width))
    for slab, first in _slabs(rows, n, slab_rows):
        matrix = _blocks(slab, first, width, block_rows)
        splits = max(1, -(-matrix.numRowBlocks // _BLOCKS_A_TASK))
        flipped = matrix.transpose()
        product = flipped._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
        total += BlockMatrix(product, width, width).toLocalMatrix().toArray()
    return total


def project(rows: DataFrame, n: int, width: int, weights: np.ndarray, staged: Staged, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """number and vector times weights, as written rows."""
    spark, path = rows.sparkSession, staged.folder()
    context, columns = spark.sparkContext, weights.shape[1]
    right = BlockMatrix(context.parallelize([((0, 0), DenseMatrix(width, columns, weights.ravel(order="F")))], 1), width, columns)
    for slab, first in _slabs(rows, n, slab_rows):
        product = _blocks(slab, first, width, block_rows).multiply(right).toIndexedRowMatrix()
        values = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model), "vector")
        values.select((F.col("index") + first).alias("number"), vector_to_array("vector").alias("vector")).write.mode("append").parquet(path)
    return spark.read.schema("number long, vector array<double>").parquet(path)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes the integer x = floor(1024 c) + 100000. Components are eigenvectors of the
    covariance of all x (divisor n), by falling eigenvalue; as many as `components`, and only those of
    some variance, so that constant vectors, a single one or none give no rows. Rows are left out whose
    vector is null or empty, holds null or non-finite entries or some of 2^42 and more, whose x would
    not be exact, or is of another length than most (of two as frequent, the longer counts). Repeated
    rows and ids count each, null ids too; deviation is null where it exceeds 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "whitening")
    sound = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**42))  # not so for NaN, which is greatest
    raw = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias(vector_col)).where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound)
    whole = F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    sizes = raw.groupBy(F.size(vector_col).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = sizes["width"] if sizes else 1
    rows, n = _numbered(raw.where(F.size(vector_col) == width).select("id", whole.alias("x")), staged)
    nothing = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], nothing)
    parts = rows.select("x").mapInArrow(_column_sums, "place int, part long").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("total"))
    sums = [int(r["total"]) for r in sorted(parts.collect())]
    apart = rows.select("number", "x").mapInArrow(_centred(n, sums), "number long, vector array<double>, deviation long")
    centred = staged.write(apart)

    covariance = scatter(centred, n, width, slab_rows, block_rows) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    some = values > _LEAST_SHARE * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return spark.createDataFrame([], nothing)
    white = project(centred, n, width, axes / np.sqrt(values), staged, slab_rows, block_rows)

    k = len(values)
    means = white.agg(*[F.avg(F.col("vector")[i]).alias(f"mean{i}") for i in range(k)]).first()
    apart = F.array(*[F.col("vector")[i] - F.lit(means[i]) for i in range(k)])
    error = float(np.abs(scatter(white.select("number", apart.alias("vector")), n, k, slab_rows, block_rows) / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    named = rows.select("number", F.col("id").alias(id_col)).join(centred.select("number", "deviation"), "number").join(white, "number")
    return named.select(id_col, "deviation", F.posexplode("vector").alias("place", "whitened")).select(
        id_col, (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error")
    )
