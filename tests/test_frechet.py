import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs, frechet as fd
from tidemark.operators.vectors import gaussian_stats, pooled_moments, project

DIM = 16
PARAMS = fd.FrechetParams(pca_components=12, n_calibration=60, window_sample_size=200, seed=7)


def normal(rng, n, shift=0.0, dim=DIM):
    return rng.standard_normal((n, dim)) + shift


@pytest.fixture(scope="module")
def model(frame):
    rng = np.random.default_rng(0)
    return fd.fit_frechet(frame({w: normal(rng, 500) for w in range(4)}), PARAMS)


def test_distance_closed_form():
    eye = np.eye(DIM)
    assert fd.frechet_distance(np.zeros(DIM), eye, np.zeros(DIM), eye) == pytest.approx(0, abs=1e-9)
    assert fd.frechet_distance(np.zeros(DIM), eye, np.full(DIM, 0.5), eye) == pytest.approx(DIM * 0.25)
    a, b = np.diag(np.arange(1.0, DIM + 1)), 2.0 * eye
    expected = (np.sqrt(np.arange(1.0, DIM + 1)) - np.sqrt(2.0)) ** 2
    assert fd.frechet_distance(np.zeros(DIM), a, np.zeros(DIM), b) == pytest.approx(expected.sum())
    assert fd.frechet_distance(np.zeros(DIM), a, np.ones(DIM), b) == pytest.approx(
        fd.frechet_distance(np.ones(DIM), b, np.zeros(DIM), a))


def test_moments_match_numpy(frame):
    rng = np.random.default_rng(1)
    data = {1: normal(rng, 300), 2: normal(rng, 40, 0.5)}
    df = frame(data)
    pooled = np.float32(np.vstack(list(data.values()))).astype(float)
    m = pooled_moments(df)
    assert m.n == 340
    assert np.allclose(m.mean, pooled.mean(axis=0)) and np.allclose(m.covariance, np.cov(pooled, rowvar=False))
    for row in gaussian_stats(df, "window_id").collect():
        x = np.float32(data[row["window_id"]]).astype(float)
        assert row["n"] == len(x) and np.allclose(row["mean"], x.mean(axis=0))
        assert np.allclose(np.reshape(row["covariance"], (DIM, DIM)), np.cov(x, rowvar=False))


def test_projection_matches_numpy(frame):
    rng = np.random.default_rng(2)
    x = normal(rng, 20)
    mean, basis = rng.standard_normal(DIM), rng.standard_normal((3, DIM))
    rows = project(frame({1: x}), mean, basis).orderBy(F.length("post_id"), "post_id").collect()
    assert np.allclose([r["embedding"] for r in rows], (np.float32(x) - mean) @ basis.T)


def test_baseline_is_diagonal(model):
    assert model.pca_basis.shape == (12, DIM) and 0 < model.explained_variance <= 1
    assert np.allclose(model.pca_basis @ model.pca_basis.T, np.eye(12), atol=1e-8)


def test_components_are_clipped(frame):
    rng = np.random.default_rng(3)
    small = fd.fit_frechet(frame({1: normal(rng, 20)}), fd.FrechetParams(pca_components=500, n_calibration=5))
    assert len(small.pca_basis) <= 9


def test_too_small_reference(frame):
    with pytest.raises(ValueError):
        fd.fit_frechet(frame({1: np.zeros((2, DIM))}), PARAMS)


def test_alarm_only_on_shift(model, frame):
    rng = np.random.default_rng(4)
    df = frame({10: normal(rng, 300), 11: normal(rng, 300, 0.2), 12: normal(rng, 300, 1.0), 13: normal(rng, 60), 14: normal(rng, 1)})
    rows = {r["window_id"]: r for r in fd.driftlens_score(df, model).collect()}
    assert [rows[w]["driftlens_alarm"] for w in (10, 12, 13)] == [False, True, False]
    assert rows[10]["driftlens_score"] < rows[11]["driftlens_score"] < rows[12]["driftlens_score"]
    assert rows[13]["threshold"] > rows[10]["threshold"]          # small windows are noisier
    assert rows[13]["n_used"] == 60 and rows[10]["n_used"] == 200
    assert rows[14]["driftlens_score"] is None and rows[14]["driftlens_alarm"] is False


@pytest.mark.parametrize("first,rows,size", [(0, 1, 1), (7, 50, 1), (7, 50, 49), (0, 50, 50), (3, 1000, 130), (0, 977, 600)])
def test_a_draw_has_its_size_and_no_row_twice(first, rows, size):
    for draw in range(20):
        drawn = bs.Draw(f"7#{draw}", first, rows, size, size)
        whole = drawn.positions(0, first + rows + 5)
        assert len(whole) == len(np.unique(whole)) == size and whole.min() >= first and whole.max() < first + rows
        for step in (1, 13, 400):
            pieces = [drawn.positions(low, low + step) for low in range(0, first + rows + 5, step)]
            assert np.array_equal(np.sort(np.concatenate(pieces)), np.sort(whole))


def test_disjoint_sets_share_no_row_and_independent_sets_may_repeat():
    sets = [bs.Draw("1#2", 10, 400, 70, 350, i, 5) for i in range(5)]
    rows = np.concatenate([s.positions(0, 500) for s in sets])
    assert len(rows) == len(np.unique(rows)) == 350
    for step in (3, 90):
        for s in sets:
            assert sum(len(s.positions(low, low + step)) for low in range(0, 500, step)) == 70
    repeated = bs.Draw("1#2", 10, 5, 70, 0).positions(0, 500)
    assert len(repeated) == 70 and set(repeated) == set(range(10, 15))


def test_drawn_means_spread_as_without_replacement():
    """Every row equally likely; the variance of a drawn mean is that of a simple draw, for small and large shares."""
    rng = np.random.default_rng(8)
    values = rng.standard_normal(400)
    for size in (20, 200, 380):
        drawn = [bs.Draw(f"5#{size}#{d}", 0, 400, size, size).positions(0, 400) for d in range(4000)]
        share = np.bincount(np.concatenate(drawn), minlength=400) / 4000
        assert np.abs(share - size / 400).max() < 5 * np.sqrt(size / 400 * (1 - size / 400) / 4000)
        spread = np.var([values[d].mean() for d in drawn])
        assert spread == pytest.approx(values.var(ddof=1) / size * (1 - size / 400), rel=0.25)


def test_folded_shares_keep_the_moments():
    x = np.random.default_rng(9).standard_normal((300, 6)) + 3.0
    n, mean, covariance = fd.moments_of([fd.fold_rows(x[:4]), fd.fold_rows(x[4:5]), fd.fold_rows(x[5:])])
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x, rowvar=False))


@pytest.mark.parametrize("blocks", [4, 16])
def test_scores_do_not_depend_on_the_blocks(model, spark, blocks):
    """Draws inside one window, over all windows, and of the whole pool; equal with the pool in 1, 4 or 16 blocks."""
    sizes = spark.createDataFrame([(1,), (50,), (180,), (400,), (1000,)], "size bigint")

    def scored(block_rows):
        pool = bs.Pool(model.pool.frame, model.pool.groups, model.pool.counts, model.pool.width, block_rows)
        found = fd.calibration_scores(fd.FrechetModel(**{**vars(model), "pool": pool}), sizes).collect()
        return {(r["size"], r["draw"]): r["statistic"] for r in found}

    one, many = scored(model.pool.size), scored(-(-model.pool.size // blocks))
    assert one.keys() == many.keys() and len(one) == 5 * PARAMS.n_calibration
    assert all(np.isnan(one[k]) == np.isnan(many[k]) == (k[0] == 1) for k in one)
    assert all(one[k] == pytest.approx(many[k], rel=1e-9, abs=1e-12) for k in one if k[0] > 1)


def test_a_draw_equals_numpy(model, spark):
    rows = {r["pos"]: r["vec"] for r in model.pool.positioned().collect()}
    found = fd.calibration_scores(model, spark.createDataFrame([(60,)], "size bigint")).filter("draw < 3").collect()
    for r in found:
        x = np.array([rows[p] for p in fd.drawn_set(model.pool, PARAMS.seed, 60, r["draw"]).positions(0, model.pool.size)])
        expected = fd.frechet_distance(model.mu_b, model.sigma_b, x.mean(axis=0), np.cov(x, rowvar=False))
        assert r["statistic"] == pytest.approx(expected, rel=1e-9)


def test_grouped_calibration_sees_window_variation(frame):
    """Windows with small offsets: single-window draws give a higher threshold than a pooled reference."""
    rng = np.random.default_rng(5)
    offsets = [0.15 * rng.standard_normal(DIM) for _ in range(8)]
    days = {d: normal(rng, 500) + offsets[d] for d in range(8)}
    grouped = fd.fit_frechet(frame(days), PARAMS)
    pooled_days = {0: np.vstack(list(days.values()))}
    pooled = fd.fit_frechet(frame(pooled_days), PARAMS)
    spark = grouped.pool.frame.sparkSession
    size = spark.createDataFrame([(200,)], "size bigint")
    assert fd.calibrate(grouped, size).first()["threshold"] > 1.3 * fd.calibrate(pooled, size).first()["threshold"]
    new = frame({20: normal(rng, 500) + 0.15 * rng.standard_normal(DIM)})
    assert not fd.driftlens_score(new, grouped).first()["driftlens_alarm"]
    assert fd.driftlens_score(new, pooled).first()["driftlens_alarm"]


def test_threshold_is_the_percentile_and_memoised(model, spark):
    sizes = spark.createDataFrame([(100,)], "size bigint")
    scores = [r["statistic"] for r in fd.calibration_scores(model, sizes).collect()]
    found = fd.calibrate(model, sizes).filter("size = 100").first()["threshold"]
    assert found == pytest.approx(np.percentile(scores, 99))
    again = fd.calibrate(model, sizes).filter("size = 100").collect()
    assert len(again) == 1 and again[0]["threshold"] == found
