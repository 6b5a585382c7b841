"""Neighbours across range slices and exact percentiles, against plain versions."""
import math

import numpy as np
import pytest

from tidemark.operators.ordered import ranked, with_earlier
from tidemark.operators.selection import exact_percentile


@pytest.fixture
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n,size", [(0, 2), (1, 3), (23, 1), (60, 4), (9, 20)])
def test_earlier_rows_cross_slices(many_slices, n, size):
    """Slices of a few rows, some shorter than what a row looks back on; nulls among the values stay."""
    rows = [(3 * k, None if k % 5 == 2 else f"v{k}") for k in range(n)]
    frame = many_slices.createDataFrame(rows, "id bigint, v string").repartition(3)
    found = {r["id"]: [x["v"] for x in r["earlier"]] for r in with_earlier(frame, ["id"], ["v"], size).collect()}
    assert found == {i: [v for _, v in rows[max(0, k - size):k]] for k, (i, _) in enumerate(rows)}
    assert {r["id"]: r["place"] for r in ranked(frame, ["id"], "place").collect()} == {i: k for k, (i, _) in enumerate(rows)}


def plain(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    spot = share * (len(values) - 1)
    low, high = values[math.floor(spot)], values[math.ceil(spot)]
    return low if low == high else (math.ceil(spot) - spot) * low + (spot - math.floor(spot)) * high


@pytest.mark.parametrize("share", [0.0, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("limit", [3, 100_000])
def test_percentile_is_exact(spark, share, limit):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=400), "wide": np.exp(rng.normal(0, 40, 300)) * rng.choice([-1, 1], 300), "ties": rng.choice([1.5, 2.5, -7.0], 500),
              "one": np.array([4.25]), "infinite": np.array([-np.inf, -1.0, 2.0, 2.0, np.inf]), None: rng.integers(0, 50, 200).astype(float),
              "hot": np.r_[np.zeros(900), rng.normal(size=60)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("normal", None)]
    found = {r["k"]: r["p"] for r in exact_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", share, "p", limit).collect()}
    assert found == {**{k: plain(list(map(float, vs)), share) for k, vs in groups.items()}, "none": None}


def test_percentile_of_everything(spark):
    frame = spark.range(1001).selectExpr("cast(id as double) v")
    assert exact_percentile(frame, [], "v", 0.25, "p", 5).first()["p"] == 250.0
