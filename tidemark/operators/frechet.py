"""Detector A: Fréchet distance of every window to a fixed reference period.

The reference is split; one part gives the PCA basis and the baseline Gaussian, the other is the pool
from which in-distribution windows of the same size are drawn to calibrate the alarm threshold.
"""
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import bootstrap as bs
from tidemark.operators.ranking import order_key
from tidemark.operators.sampling import sample_per_window, split_reference
from tidemark.operators.vectors import Moments, matrix_of, pooled_moments, project
from tidemark.session import cut_lineage, settle, sized


@dataclass
class FrechetParams:
    """Defaults are fixed values of the published configuration."""
    pca_components: int = 150
    threshold_fraction: float = 0.5
    n_calibration: int = 1000
    percentile: float = 99.0
    window_sample_size: int = 1000
    seed: int = 42


@dataclass
class FrechetModel:
    params: FrechetParams
    pca_mean: np.ndarray
    pca_basis: np.ndarray
    explained_variance: float
    sigma_diag: np.ndarray            # baseline covariance in PCA space (diagonal), its mean is zero
    pool: bs.Pool
    thresholds: DataFrame | None = None      # (size, threshold) already calibrated
    meta: dict = field(default_factory=dict)

    @property
    def mu_b(self) -> np.ndarray:
        return np.zeros(len(self.sigma_diag))

    @property
    def sigma_b(self) -> np.ndarray:
        return np.diag(self.sigma_diag)


def sample_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    centred = x - mean
    return mean, centred.T @ centred / (len(x) - 1)


def frechet_distance(mu1, sigma1, mu2, sigma2, eps: float = 1e-6) -> float:
    """Squared mean gap + Tr(S1 + S2 - 2 (S1 S2)^1/2), by the symmetric form S1^1/2 S2 S1^1/2."""
    values, axes = np.linalg.eigh(sigma1)
    root = (axes * np.sqrt(np.clip(values, 0.0, None))) @ axes.T
    return _distance(mu1, root, np.trace(sigma1), mu2, sigma2, eps)


def _distance(mu1, root1, trace1, mu2, sigma2, eps: float = 1e-6) -> float:
    inner = root1 @ sigma2 @ root1
    if not np.isfinite(inner).all():
        ridge = eps * np.eye(len(sigma2))
        inner = np.nan_to_num(inner) + ridge
    cross = np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.T) / 2), 0.0, None)).sum()
    gap = mu1 - mu2
    return float(max(gap @ gap + trace1 + np.trace(sigma2) - 2.0 * cross, 0.0))


def _to_baseline(sigma_diag: np.ndarray):
    """Distance of projected rows to the baseline (mean zero, diagonal covariance); NaN below two rows."""
    root = np.sqrt(np.clip(sigma_diag, 0.0, None))
    trace, origin = float(sigma_diag.sum()), np.zeros(len(sigma_diag))

    def distance(rows: np.ndarray) -> float:
        if len(rows) < 2:
            return float("nan")
        mean, covariance = sample_moments(rows)
        return _distance(origin, np.diag(root), trace, mean, covariance)

    return distance


def fit_pca(moments: Moments, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(basis k x d, variances k, explained share) of a covariance; k is clipped to dim and n - 1."""
    values, axes = np.linalg.eigh(moments.covariance)
    keep = np.argsort(values)[::-1][: min(k, len(values), moments.n - 1)]
    variances = np.clip(values[keep], 0.0, None)
    return axes[:, keep].T.copy(), variances, float(variances.sum() / max(values.sum(), 1e-300))


def fit_frechet(reference: DataFrame, params: FrechetParams = FrechetParams(), meta: dict | None = None) -> FrechetModel:
    """Fit on reference vectors `(window_id, post_id, embedding)`; each window id is a calibration group."""
    split = cut_lineage(split_reference(reference.select("window_id", "post_id", "embedding"),
                                        params.threshold_fraction, params.seed))
    held = split.filter("is_threshold")
    baseline = pooled_moments(split.filter("NOT is_threshold"))
    if baseline.n < 2:
        raise ValueError("reference set too small: fewer than two vectors in the baseline part")
    basis, variances, share = fit_pca(baseline, params.pca_components)
    pool = threshold_pool(held, baseline.mean, basis, params.seed)
    if pool.size < 2:
        raise ValueError("reference set too small: fewer than two vectors in the threshold part")
    return FrechetModel(params, baseline.mean, basis, share, variances, pool, meta=meta or {})


def threshold_pool(held: DataFrame, mean: np.ndarray, basis: np.ndarray, seed: int) -> bs.Pool:
    """Projected held-out rows with their reference window."""
    keyed = held.withColumn("order_key", order_key(seed, "window_id", "post_id", tie="post_id"))
    rows = project(keyed.select("window_id", "order_key", "embedding"), mean, basis)
    frame = rows.select(F.col("window_id").alias("grp"), "order_key", F.col("embedding").alias("vec"))
    return bs.make_pool(frame, len(basis), held.select(F.col("window_id").alias("grp")))


def calibration_draws(sizes: DataFrame, n_draws: int) -> DataFrame:
    """(size, draw) for every distinct size."""
    draws = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long")))
    return sizes.select(F.col("size").cast("long").alias("size")).distinct().select("size", draws.alias("draw"))


def drawn_set(pool: bs.Pool, seed: int, size: int, draw: int) -> bs.Draw:
    """Rows of one calibration draw: round-robin over windows that hold `size` rows, else pooled; all rows of a short pool."""
    first, rows = 0, pool.size
    eligible = np.flatnonzero(pool.counts >= size)
    if len(eligible):
        chosen = eligible[draw % len(eligible)]
        first, rows = int(pool.starts[chosen]), int(pool.counts[chosen])
    size = min(size, rows)
    return bs.Draw(f"{seed}#{size}#{draw}", first, rows, size, size)


def fold_rows(rows: np.ndarray, whole: bool = False) -> np.ndarray:
    """Rows with a leading one, or the triangular factor with the same products once there are more rows than columns.

    The factor of a `whole` draw is not needed, nothing else joins it.
    """
    full = np.column_stack([np.ones(len(rows)), rows])
    return full if whole or len(full) <= full.shape[1] else np.linalg.qr(full, mode="r")


def moments_of(shares: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of all rows behind folded shares."""
    stacked = np.vstack(shares)
    n = round(float(stacked[:, 0] @ stacked[:, 0]))
    mean = stacked[:, 0] @ stacked[:, 1:] / n
    centred = stacked[:, 1:] - stacked[:, :1] * mean
    return n, mean, centred.T @ centred / max(n - 1, 1)


def calibration_scores(model: FrechetModel, sizes: DataFrame) -> DataFrame:
    """Distance of every calibration draw to the baseline; NaN below two rows.

    A block's share of a draw holds n, the sums and the products of its rows, so only that is shuffled, and only
    for draws that cross blocks.
    """
    layout = bs.Pool(None, model.pool.groups, model.pool.counts, model.pool.width)       # travels without its frame
    root = np.diag(np.sqrt(np.clip(model.sigma_diag, 0.0, None)))
    trace, origin, seed = float(model.sigma_diag.sum()), model.mu_b, model.params.seed

    def finish(key: dict, shares: list[np.ndarray]) -> float:
        n, mean, covariance = moments_of(shares)
        return float("nan") if n < 2 else _distance(origin, root, trace, mean, covariance)

    keys = sizes.select(F.col("size").cast("long").alias("size"))
    return bs.run_draws(keys, model.params.n_calibration, model.pool,
                        lambda key, draw: [drawn_set(layout, seed, key["size"], draw)], lambda sets, whole: fold_rows(sets[0], whole), finish)


def calibrate(model: FrechetModel, sizes: DataFrame) -> DataFrame:
    """(size, threshold) for all sizes; sizes calibrated before are not drawn again."""
    known = model.thresholds
    wanted = sizes.select(F.least("size", F.lit(model.pool.size)).cast("long").alias("size")).distinct()
    missing = wanted if known is None else wanted.join(known, "size", "left_anti")
    fresh = bs.p_threshold(calibration_scores(model, missing), ["size"], model.params.percentile)
    model.thresholds = settle(fresh if known is None else known.unionByName(fresh))
    return model.thresholds


def window_distances(vectors: DataFrame, model: FrechetModel) -> DataFrame:
    """Distance of every window's sample to the baseline; NULL for windows below two rows.

    One group holds at most `window_sample_size` rows, so projection and moments are bounded.
    """
    params, limit = model.params, model.pool.size
    sample = sample_per_window(vectors.select("window_id", "post_id", "embedding"), params.window_sample_size, params.seed)
    used = sample.filter(F.col("rn") <= limit).select("window_id", "rn", "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast((model.pca_mean, model.pca_basis, model.sigma_diag))

    def score(table: pa.Table) -> pa.Table:
        mean, basis, sigma = shared.value
        rows = matrix_of(table.column("embedding"))[np.argsort(table.column("rn").to_numpy())]
        value = _to_baseline(sigma)((rows - mean) @ basis.T)
        return pa.table({
            "window_id": [table.column("window_id")[0].as_py()],
            "driftlens_score": pa.array([None if np.isnan(value) else value], pa.float64()),
            "n_used": pa.array([len(rows)], pa.int64()),
        })

    return used.groupBy("window_id").applyInArrow(score, "window_id bigint, driftlens_score double, n_used bigint")


def driftlens_score(vectors: DataFrame, model: FrechetModel) -> DataFrame:
    """Score, calibrated threshold for the sample size used, and alarm (strictly above) per window."""
    distances = cut_lineage(window_distances(vectors, model))
    thresholds = calibrate(model, distances.filter("n_used >= 2").select(F.col("n_used").alias("size")))
    joined = distances.join(sized(thresholds), distances["n_used"] == thresholds["size"], "left").drop("size")
    alarm = F.coalesce(F.col("driftlens_score") > F.col("threshold"), F.lit(False))
    return joined.select(
        "window_id", F.round("driftlens_score", 6).alias("driftlens_score"), alarm.alias("driftlens_alarm"),
        F.round("threshold", 6).alias("threshold"), "n_used",
    )


def params_of(model: FrechetModel) -> dict:
    return asdict(model.params)
