"""Rows beside the rows before them in a global order, without a window over everything in one task.

The order is cut into range slices; a slice's last rows are handed on to the first rows of the slices after it.
"""
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import cut_lineage, sized

_SLICE, _PLACE, _RANK = "slice_no", "slice_place", "slice_rank"


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the slice they lie in, their place in it and their rank in the whole order, all from 0.

    Materialised once, because range bounds come from a sample.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(_PLACE, F.monotonically_increasing_id())
        .withColumn(_SLICE, F.shiftright(_PLACE, 33))
        .withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy(_SLICE).agg(F.count("*").alias("slice_rows"))
    earlier = sizes.select(F.col(_SLICE).alias("earlier_no"), F.col("slice_rows").alias("earlier_rows"))
    # One row for each range partition on either side.
    offsets = sized(sizes.join(earlier, F.col("earlier_no") < F.col(_SLICE), "left").groupBy(_SLICE, "slice_rows").agg(
        F.coalesce(F.sum("earlier_rows"), F.lit(0)).alias("slice_start")))
    return placed.join(offsets, _SLICE).withColumn(_RANK, F.col("slice_start") + F.col(_PLACE))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based rank in the order given."""
    return _sliced(df, order).withColumn(name, F.col(_RANK)).drop(_SLICE, _PLACE, _RANK, "slice_rows", "slice_start")


def with_earlier(df: DataFrame, order: list[str], values: list[str], size: int, name: str = "earlier") -> DataFrame:
    """Adds an array of structs: `values` of the up to `size` rows before each row, the nearest last.

    A row looks back inside its slice; only the first `size` rows of a slice look further, and only the last `size`
    rows of a slice are looked for, so what crosses slices is bounded by their number.
    """
    rows = _sliced(df, order)
    inside = Window.partitionBy(_SLICE).orderBy(_PLACE).rowsBetween(-size, -1)
    asked = rows.where((F.col(_PLACE) < size) & (F.col("slice_start") > 0)).select(
        F.col(_RANK), F.explode(F.sequence(F.greatest(F.col(_RANK) - size, F.lit(0)), F.col("slice_start") - 1)).alias("asked"))
    handed = rows.where(F.col(_PLACE) >= F.col("slice_rows") - size).select(F.col(_RANK).alias("asked"), F.struct(*values).alias("value"))
    carried = asked.join(handed, "asked").groupBy(_RANK).agg(
        F.sort_array(F.collect_list(F.struct("asked", "value"))).alias("carried"))
    carried = carried.select(_RANK, F.transform("carried", lambda x: x["value"]).alias("carried"))
    own = F.collect_list(F.struct(*values)).over(inside)
    return rows.withColumn(name, own).join(sized(carried), _RANK, "left").withColumn(
        name, F.when(F.col("carried").isNull(), F.col(name)).otherwise(F.concat("carried", name))).drop(
        _SLICE, _PLACE, _RANK, "slice_rows", "slice_start", "carried")
