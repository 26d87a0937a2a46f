"""Whitening of embeddings by distributed block matrices.

Distinct vectors are numbered rows of an IndexedRowMatrix of centred values, which becomes a BlockMatrix. The matrix times its
own transpose is the scatter, a matrix of dimension by dimension that alone comes to the driver; its eigenvectors (numpy's eigh)
over the roots of their eigenvalues are the whitening matrix, and the BlockMatrix times that one projects every row.

The product of a tall matrix with its transpose has few blocks, so the inner dimension is split: a task multiplies at most
BLOCKS_AT_ONCE blocks of about BLOCK_BYTES and hands on one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, numbered, settle

#: Bytes of a block of doubles, and blocks that a task of the scatter holds at once.
BLOCK_BYTES = 1 << 20
BLOCKS_AT_ONCE = 32
#: Columns of a block.
BLOCK_COLUMNS = 1024
#: Eigenvalues at or below this share of their sum count as zero: such components cannot be scaled and are left out.
RANK = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, x): floor(scale * entry) as long, for every row whose vector is not null or empty and has only finite entries.

    Vectors must have one length: of several lengths the most frequent one stays (ties: the longer one)."""
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    x = x.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    x = x.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return x.filter(F.size("x") == (lengths[0].d if lengths else 0))


def centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(idx, x, deviation, centred) of rows (idx, x): the sum of (n * x - S)^2 in whole numbers (null where a long cannot hold it)
    and (n * x - S) / n as doubles."""

    def run(batches):
        s = np.array(sums, object)
        top = max(map(abs, sums), default=0)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            most = max(abs(int(x.max())), abs(int(x.min()))) * n + top
            exact = most * most * x.shape[1] < 1 << 62
            y = x * np.int64(n) - s.astype(np.int64) if exact else x.astype(object) * n - s
            total = (y * y).sum(axis=1)
            deviation = pa.array(total) if exact else pa.array([t if t < 1 << 63 else None for t in total.tolist()], pa.int64())
            middle = (y / n).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, middle.size + 1, x.shape[1], dtype=np.int32)), pa.array(middle.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), deviation, values], names=["idx", "x", "deviation", "centred"])

    return fit.select("idx", "x").mapInArrow(run, "idx long, x array<long>, deviation long, centred array<double>")


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Rows (idx, centred) as a BlockMatrix of about BLOCK_BYTES a block."""
    vector = MLUtils.convertVectorColumnsFromML(rows.select(F.col("idx").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    columns = min(d, BLOCK_COLUMNS)
    return IndexedRowMatrix(vector, n, d).toBlockMatrix(max(1, BLOCK_BYTES // (8 * columns)), columns)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, as a local array; the inner dimension is split over tasks."""
    splits = max(1, -(-m.numRowBlocks // BLOCKS_AT_ONCE) * max(1, BLOCKS_AT_ONCE // 4))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns: unit eigenvectors over the roots of their eigenvalues, eigenvalues), by falling eigenvalue, `most` at most. Of
    each eigenvector's two signs the one with a positive largest entry is taken."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [i for i in np.argsort(-e, kind="stable")[:most] if e[i] > RANK * max(e.sum(), 0)]
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return v / np.sqrt(e[order]), e[order]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row per remaining input row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries go; of vectors of several lengths the most frequent
    length stays. Each distinct quantised vector counts once in the fit. Repeated rows and null ids stay, each with its own
    rows. A component whose eigenvalue is zero has no rows, so one distinct vector gives none; an empty table gives none.
    Further columns are ignored. deviation is null where a long cannot hold it."""
    spark = vectors.sparkSession
    x = settle(quantised(vectors, id_col, vector_col))
    distinct = settle(x.select("x").distinct())
    fit = settle(numbered(distinct))
    sums = sorted(fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect())
    n, d = (sums[0].n, len(sums)) if sums else (0, 0)
    if n < 2:
        discard(x, distinct, fit)
        return spark.createDataFrame([], SCHEMA)
    rows = settle(centred(fit, n, [int(r.s) for r in sums]))
    m = block_matrix(rows, n, d)
    covariance = scatter(m) / n
    w, e = whitening_matrix(covariance, components)
    if not len(e):
        discard(x, distinct, fit, rows)
        return spark.createDataFrame([], SCHEMA)
    across = m.colsPerBlock
    parts = [((i, 0), DenseMatrix(len(p), len(e), p.ravel(order="F").tolist())) for i, p in enumerate(w[a : a + across] for a in range(0, d, across))]
    projected = m.multiply(BlockMatrix(spark.sparkContext.parallelize(parts, 1), across, len(e), d, len(e)))
    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    found = settle(found.select(F.col("index").alias("idx"), vector_to_array("vector").alias("w")))
    error = float(np.abs(scatter(block_matrix(found.withColumnRenamed("w", "centred"), n, len(e))) / n - np.eye(len(e))).max())
    known = settle(rows.select("idx", "x", "deviation").join(found, "idx").drop("idx"))
    share = F.element_at(F.array(*(F.lit(float(v / np.trace(covariance))) for v in e)), F.col("pos") + 1)
    discard(distinct, fit, rows, found)
    out = x.join(known, "x").select("vec_id", "deviation", F.posexplode("w").alias("pos", "whitened"))
    return out.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
