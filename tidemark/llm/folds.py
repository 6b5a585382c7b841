"""Folds by checksum, samples of bounded size, and column names that an operator must not touch."""
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def thinned(df: DataFrame, group: str, limit: int, key: str = "doc_id") -> DataFrame:
    """About `limit` rows of each group, chosen by a hash of the key; groups of fewer rows stay whole.

    One count decides the share of every group, so no group is sorted or held in one task. At most 2 * limit rows of a
    group remain but for a chance below 1e-9 from limits of 100 on.
    """
    share = [(F.col(group) == r[group], min(1.0, limit / r["count"])) for r in df.groupBy(group).count().collect() if r[group] is not None]
    part = F.lit(0.0)
    for hit, p in share:
        part = F.when(hit, p).otherwise(part)
    return df.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) / float(1 << 20) < part)


def protected(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with its columns of these names set aside under others, and the way back to all columns of `df`."""
    mark = prefix_for(df)
    aside = {c: f"{mark}aside_{k}" for k, c in enumerate(df.columns) if c in set(names)}
    back = [f"`{aside[c]}` as `{c}`" if c in aside else f"`{c}`" for c in df.columns]
    return df.withColumnsRenamed(aside), lambda out: out.selectExpr(*back)


def prefix_for(df: DataFrame) -> str:
    """A prefix that no column of `df` begins with, for working columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
