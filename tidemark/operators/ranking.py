"""Ranks and cuts that never put a whole hot group into one task.

Hash order: every row gets an order key `md5(seed#parts...)#id`. Its leading hex digits split any
group, however large, into even buckets that depend on the data alone, so counts per bucket give
the offsets and only one bucket has to be ranked row by row.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage, sized

BUCKET_DIGITS = 3          # 4,096 buckets per group; raise it for groups above some 10^10 rows
POOLED = "pooled_key"      # constant group used when the whole frame is one group


def order_key(seed, *parts: str, tie: str) -> Column:
    """Seeded, engine-independent order: md5 text followed by the row id as tie break."""
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    return F.concat_ws("#", digest, F.col(tie).cast("string"))


def _bucket() -> Column:
    return F.substring("order_key", 1, BUCKET_DIGITS)


def _edges(keys: DataFrame, group: list[str], quota: Column) -> DataFrame:
    """Per group: the bucket in which the quota-th row lies and how many of its rows are wanted.

    `quota` may use `group_rows`. Groups whose quota is zero or negative have no edge.
    """
    counts = keys.groupBy(*group, _bucket().alias("edge")).agg(F.count("*").alias("bucket_rows"))
    by_group = Window.partitionBy(*group)
    return (
        counts
        .withColumn("group_rows", F.sum("bucket_rows").over(by_group))
        .withColumn("hi", F.sum("bucket_rows").over(by_group.orderBy("edge")))
        .withColumn("lo", F.col("hi") - F.col("bucket_rows"))
        .withColumn("quota", F.least(quota.cast("long"), F.col("group_rows")))
        .filter("lo < quota AND quota <= hi")
        .select(*group, "edge", (F.col("quota") - F.col("lo")).alias("wanted"), "group_rows")
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL (a NULL group is a group); the left side's keys stay."""
    renamed = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"{k}__right"]) for k in keys]
    return left.join(renamed, on, how).drop(*(f"{k}__right" for k in keys))


def take_lowest(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """At most `n` rows of every group, those with the lowest `order_key`, numbered `rn` from 1; all rows for n <= 0.

    Spark limits every group before the shuffle (WindowGroupLimit), so a hot group moves n rows for each map task.
    """
    if n <= 0:
        return rank_by_hash(df, group, "rn").withColumn("rn", (F.col("rn") + 1).cast("int"))
    ranked = Window.partitionBy(*group).orderBy("order_key")
    return df.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= n)


def split_lowest(df: DataFrame, group: list[str], quota: Column, flag: str) -> DataFrame:
    """All rows, with `flag` true for the `quota` rows of lowest `order_key` in every group.

    `quota` may use `group_rows`. The quota-th key of each group is looked up in its edge bucket and compared on the
    map side, so the payload is not ranked and a hot group has one bucket ranked in a task.
    """
    keys = df.select(*group, "order_key")
    edges = sized(_edges(keys, group, quota).drop("group_rows"))
    at_edge = _same(keys.withColumn("edge", _bucket()), edges, [*group, "edge"])
    ranked = Window.partitionBy(*group).orderBy("order_key")
    cutoffs = sized(at_edge.withColumn("rn", F.row_number().over(ranked)).filter("rn = wanted")
                    .select(*group, F.col("order_key").alias("cutoff")))
    return _same(df, cutoffs, group, "left").withColumn(
        flag, F.coalesce(F.col("order_key") <= F.col("cutoff"), F.lit(False))).drop("cutoff")


def rank_by_hash(df: DataFrame, group: list[str], name: str = "rank") -> DataFrame:
    """0-based rank of every row inside its group in `order_key` order, in one payload shuffle.

    Rows are ranked inside (group, bucket); the bucket offsets come from counts.
    """
    keyed = df.withColumn("hash_bucket", _bucket())
    counts = keyed.groupBy(*group, "hash_bucket").agg(F.count("*").alias("bucket_rows"))
    running = Window.partitionBy(*group).orderBy("hash_bucket")
    offsets = counts.select(
        *group, "hash_bucket", (F.sum("bucket_rows").over(running) - F.col("bucket_rows")).alias("bucket_offset")
    )
    inside = Window.partitionBy(*group, "hash_bucket").orderBy("order_key")
    return (
        _same(keyed.withColumn("rn", F.row_number().over(inside)), offsets, [*group, "hash_bucket"])
        .withColumn("bucket_offset", F.col("bucket_offset") + F.col("rn") - 1)
        .drop("rn", "hash_bucket").withColumnRenamed("bucket_offset", name)
    )


def pooled(df: DataFrame) -> DataFrame:
    return df.withColumn(POOLED, F.lit(0))


def permute(df: DataFrame, seed, id_col: str, name: str = "rank") -> DataFrame:
    """Seeded random permutation rank over the whole frame (0-based)."""
    keyed = pooled(df).withColumn("order_key", order_key(seed, id_col, tie=id_col))
    return rank_by_hash(keyed, [POOLED], name).drop(POOLED, "order_key")


def global_rank(df: DataFrame, order: list[str], name: str = "row_index", partitions: int | None = None) -> DataFrame:
    """0-based rank over a natural order, without a single-partition window.

    Range partitions are sorted and materialised once (the range bounds come from a sample, so they
    must not be drawn twice); the local position is the low part of `monotonically_increasing_id`
    and the offsets are running totals over one row per partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("local_id", F.monotonically_increasing_id())
        .withColumn("slice", F.shiftright("local_id", 33))
    )
    sizes = placed.groupBy("slice").agg(F.count("*").alias("slice_rows"))
    offsets = sizes.select(
        "slice", (F.sum("slice_rows").over(Window.orderBy("slice")) - F.col("slice_rows")).alias("slice_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "slice")     # one row per shuffle partition
        .withColumn(name, F.col("slice_offset") + F.col("local_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("slice", "slice_offset", "local_id")
    )
