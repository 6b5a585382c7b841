"""Vector aggregates: means, spreads, covariances, projections."""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions import vectors as vx

MAX_DIMENSION = 2048      # a covariance of this width (32 MB) is the largest the driver decomposes


def matrix_of(column, dtype=np.float64) -> np.ndarray:
    """Arrow list column -> (rows, dim) matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(rows, -1) if rows else np.empty((0, 0), dtype)


def mean_pool(vectors: DataFrame, by: str = "window_id", column: str = "embedding") -> DataFrame:
    """Mean vector per group; JVM summariser with partial sums on the map side."""
    pooled = vectors.groupBy(by).agg(Summarizer.mean(array_to_vector(F.col(column))).alias("m"))
    return pooled.select(by, vector_to_array("m").alias("mean"))


def fit_scaler(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: per-dimension mean and population standard deviation plus 1e-6."""
    metrics = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(column)))
    row = vectors.agg(metrics.alias("s")).select(
        F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var")
    )
    to_population = F.try_divide(F.col("n") - 1, F.col("n"))
    std = F.transform("var", lambda v: F.sqrt(v * to_population) + F.lit(1e-6))
    return row.select("n", "mean", std.alias("std"))


def standardise(vectors: DataFrame, scaler: DataFrame, column: str = "embedding") -> DataFrame:
    """(x - mean) / std with the one-row scaler."""
    one_row = F.broadcast(scaler.select("mean", "std").withColumn("scaler_key", F.lit(0)))
    return (
        vectors.withColumn("scaler_key", F.lit(0)).join(one_row, "scaler_key")
        .withColumn(column, vx.standardise(F.col(column), F.col("mean"), F.col("std")))
        .drop("scaler_key", "mean", "std")
    )


def l2_normalise(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, vx.l2_normalise(F.col(column)))


def _partial_moments(by: str | None, column: str):
    """Arrow batches -> rows (group, i, vector): i = -1 holds [n, sum], i >= 0 row i of the sum of x xT."""
    def run(batches):
        sums: dict = {}
        for batch in batches:
            x = matrix_of(batch.column(column))
            if not len(x):
                continue
            groups = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(len(x), dtype=np.int64)
            for g in np.unique(groups):
                part = x if by is None else x[groups == g]
                n, total, product = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(part), total + part.sum(axis=0), product + part.T @ part)
            if len(sums) > 256:      # bound the worker's memory when a task sees many groups
                yield _moment_rows(sums, by)
                sums = {}
        if sums:
            yield _moment_rows(sums, by)
    return run


def _moment_rows(sums: dict, by: str | None) -> pa.RecordBatch:
    groups, index, rows = [], [], []
    for g, (n, total, product) in sums.items():
        width = len(total)
        groups += [g] * (width + 1)
        index += range(-1, width)
        rows.append(np.concatenate([[n], total]))
        rows += [np.concatenate([[0.0], r]) for r in product]
    return pa.RecordBatch.from_pydict({"grp": groups, "i": pa.array(index, pa.int32()),
                                       "v": pa.array(rows, pa.list_(pa.float64()))})


def moment_sums(vectors: DataFrame, by: str | None = None, column: str = "embedding") -> DataFrame:
    """Summed moments in rows (grp, i, v), keyed by matrix row so that a hot group uses many reducers."""
    kind = dict(vectors.dtypes)[by] if by else "bigint"
    columns = [c for c in (by, column) if c]
    partial = vectors.select(*columns).mapInArrow(_partial_moments(by, column), f"grp {kind}, i int, v array<double>")
    summed = partial.groupBy("grp", "i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    return summed.select("grp", "i", vector_to_array("s").alias("v"))


def gaussian_stats(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """Per group: n, mean vector and covariance (N-1) as a row-major array (d x d values)."""
    sums = moment_sums(vectors, by, column)
    heads = sums.filter("i = -1").select(
        "grp", F.round(F.col("v")[0]).cast("long").alias("n"), F.slice("v", F.lit(2), F.size("v") - 1).alias("total")
    )
    mean = F.transform("total", lambda t: t / F.col("n"))
    heads = heads.select("grp", "n", mean.alias("mean"))
    # Row i of the covariance: (sum x_i x - n mean_i mean) / (n - 1).
    rows = sums.filter("i >= 0").join(heads, "grp").select(
        "grp", "n", "mean", "i",
        F.zip_with(F.slice("v", F.lit(2), F.size("v") - 1), "mean", lambda s, m: F.try_divide(
            s - F.col("n") * F.get("mean", F.col("i")) * m, F.col("n") - 1)).alias("row"),
    )
    return rows.groupBy("grp").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"])).alias("covariance"),
    ).withColumnRenamed("grp", by)


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    covariance: np.ndarray


def pooled_moments(vectors: DataFrame, column: str = "embedding") -> Moments:
    """Mean and covariance of a whole frame on the driver: d + 1 rows, whatever the number of vectors."""
    rows = {r["i"]: np.asarray(r["v"]) for r in moment_sums(vectors, None, column).limit(MAX_DIMENSION + 2).collect()}
    if not rows:
        return Moments(0, np.empty(0), np.empty((0, 0)))
    if len(rows) - 1 > MAX_DIMENSION:
        raise ValueError(f"vectors wider than {MAX_DIMENSION} dimensions are not supported")
    n, total = round(rows[-1][0]), rows[-1][1:]
    product = np.vstack([rows[i][1:] for i in range(len(total))])
    mean = total / n
    return Moments(n, mean, (product - n * np.outer(mean, mean)) / max(n - 1, 1))


def project(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray, column: str = "embedding") -> DataFrame:
    """(x - mean) . basis^T in Arrow batches; the other columns pass through."""
    schema = StructType([
        f if f.name != column else StructField(column, ArrayType(DoubleType())) for f in vectors.schema.fields
    ])
    shared = vectors.sparkSession.sparkContext.broadcast((mean, basis))     # (k + 1) x d numbers

    def run(batches):
        centre, axes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = (matrix_of(batch.column(column)) - centre) @ axes.T
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(
                [lists if name == column else batch.column(name) for name in batch.schema.names], batch.schema.names
            )

    return vectors.mapInArrow(run, schema)
