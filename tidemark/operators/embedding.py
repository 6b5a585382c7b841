"""Text -> unit vectors, with a cache that embeds every distinct text once."""
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as tx

BATCH_SIZE = 256


def embed(posts: DataFrame, dim: int = 384, column: str = "text") -> DataFrame:
    """Hashed term counts scaled to unit length: the model-free embedder, entirely in the JVM."""
    tokens = posts.withColumn("tokens", tx.tokenize(F.coalesce(F.col(column), F.lit(""))))
    counted = HashingTF(numFeatures=dim, inputCol="tokens", outputCol="counts").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="counts", outputCol="unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("unit", "float32")).drop("tokens", "counts", "unit")


def embed_with(posts: DataFrame, factory: Callable, column: str = "text", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Pluggable embedder: `factory()` loads the model once per worker and returns texts -> matrix."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            parts = [np.asarray(model(texts.iloc[i:i + batch_size].tolist()), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            rows = np.vstack(parts) if parts else np.empty((0, 0), dtype=np.float32)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(length > 0, length, 1.0)))

    return posts.withColumn("embedding", encode(F.col(column)))


def cache_misses(posts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (by SHA-1) without a cached vector of this model; a NULL text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    wanted = posts.select(F.sha1(text).alias("text_sha1"), text.alias("text")).groupBy("text_sha1").agg(F.min("text").alias("text"))
    return wanted.join(cache.filter(F.col("model") == model).select("text_sha1"), "text_sha1", "left_anti")


def embed_cached(posts: DataFrame, cache_path: str, model: str, embedder: Callable = embed) -> DataFrame:
    """Embed through a Parquet cache keyed by (model, SHA-1 of the text); only misses are embedded.

    The key holds the content, so a window whose texts changed can never hit a stale vector. An
    interrupted run leaves no partial file behind, and copies from two runs fold on reading.
    """
    spark = posts.sparkSession
    schema = "model string, text_sha1 string, embedding array<float>"
    try:
        cache = spark.read.schema(schema).parquet(cache_path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        cache = spark.createDataFrame([], schema)
    fresh = embedder(cache_misses(posts, cache, model)).select(F.lit(model).alias("model"), "text_sha1", "embedding")
    fresh.write.mode("append").parquet(cache_path)
    stored = spark.read.schema(schema).parquet(cache_path).filter(F.col("model") == model)
    unique = stored.dropDuplicates(["text_sha1"]).select("text_sha1", "embedding")
    return posts.withColumn("text_sha1", F.sha1(F.coalesce("text", F.lit("")))).join(unique, "text_sha1").drop("text_sha1")
