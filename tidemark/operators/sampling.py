"""Seeded samples and splits (fixed size per window, exact shares)."""
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ranking import POOLED, order_key, pooled, split_lowest, take_lowest


def sample_per_window(df: DataFrame, n: int, seed: int, group: str = "window_id", id_col: str = "post_id") -> DataFrame:
    """At most `n` rows per window without replacement, all for n <= 0; `rn` is the order of the draw."""
    keyed = df.withColumn("order_key", order_key(seed, group, id_col, tie=id_col))
    return take_lowest(keyed, [group], n).drop("order_key")


def split_reference(df: DataFrame, fraction: float, seed: int, id_col: str = "post_id") -> DataFrame:
    """Pooled split: `is_threshold` marks the exact rounded share (half-even) of all rows."""
    keyed = pooled(df).withColumn("order_key", order_key(seed, id_col, tie=id_col))
    quota = F.bround(F.col("group_rows") * F.lit(fraction), 0)
    return split_lowest(keyed, [POOLED], quota, "is_threshold").drop(POOLED, "order_key")


def holdout_split(df: DataFrame, fraction: float, seed: int, group: str = "window_id",
                  id_col: str = "post_id") -> DataFrame:
    """Split every window: `is_heldout` marks its rounded share (half-even per window)."""
    keyed = df.withColumn("order_key", order_key(seed, group, id_col, tie=id_col))
    quota = F.bround(F.col("group_rows") * F.lit(fraction), 0)
    return split_lowest(keyed, [group], quota, "is_heldout").drop("order_key")
