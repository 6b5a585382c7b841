"""Detector B: maximum concept discrepancy over a sliding context.

A window is a set of vectors; an ensemble of set encoders (item layer, mean, set layer) turns it into one
concept vector, and the score is the largest distance to the concept vectors of the previous windows.
The mean is linear, so item features are computed once per row and every set is a mean of features.
"""
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import vectors as vx
from tidemark.functions.scoring import sig
from tidemark.operators import bootstrap as bs
from tidemark.operators.contexts import context_frame, context_pairs
from tidemark.operators.ranking import global_rank, order_key
from tidemark.operators.sampling import holdout_split, sample_per_window
from tidemark.operators.vectors import fit_scaler, matrix_of
from tidemark.operators.windowing import positions
from tidemark.session import cut_lineage, settle, sized


@dataclass
class ConceptParams:
    """Defaults are fixed values of the published configuration."""
    hidden_dim: int = 128
    output_dim: int = 64
    n_encoders: int = 5
    lr: float = 1e-3
    lambda_gp: float = 1.0
    lipschitz_k: float = 1.0
    eps_small: float = 0.03
    eps_big: float = 0.3
    n_sub_windows: int = 5
    sample_set_size: int = 100
    k_pairs: int = 10
    train_epochs: int = 100
    scoring_sample_size: int = 1000
    context_windows: int = 10
    n_calibration: int = 500
    percentile: float = 99.0
    online_training: bool = False
    holdout_fraction: float = 0.8
    seed: int = 42


def init_weights(dim: int, params: ConceptParams) -> list[dict]:
    """Uniform +-1/sqrt(fan-in) weights and biases, one seeded start per ensemble member."""
    h, o = params.hidden_dim, params.output_dim
    shapes = (("item", h, dim), ("mix", h, h), ("set", h, h), ("out", o, h))
    members = []
    for member in range(params.n_encoders):
        rng = np.random.default_rng([params.seed, member])
        weights = {}
        for name, rows, cols in shapes:
            bound = 1.0 / np.sqrt(cols)
            weights[f"{name}_w"] = rng.uniform(-bound, bound, (rows, cols))
            weights[f"{name}_b"] = rng.uniform(-bound, bound, rows)
        members.append(weights)
    return members


LAYERS = ("item", "mix", "set", "out")


def fixed_members(dim: int, params: ConceptParams) -> list[dict]:
    """An encoder whose weights and biases (the place after a row's weights) are a formula of their place.

    With k = 1009 row + 917 column + 613 layer + 307 member + 1 the weight is ((k^2 + 3 k) mod 2003 - 1001) / 1001,
    scaled by the root of the fan-in. It needs no training and no generator, so any engine can repeat its scores.
    """
    h, o = params.hidden_dim, params.output_dim
    shapes = dict(zip(LAYERS, ((h, dim), (h, h), (h, h), (o, h))))
    members = []
    for member in range(params.n_encoders):
        weights = {}
        for layer, (name, (rows, cols)) in enumerate(shapes.items()):
            k = 1009 * np.arange(rows)[:, None] + 917 * np.arange(cols + 1) + 613 * layer + 307 * member + 1
            values = ((k * k + 3 * k) % 2003 - 1001) / 1001.0 / np.sqrt(cols)
            weights[f"{name}_w"], weights[f"{name}_b"] = values[:, :cols], values[:, cols]
        members.append(weights)
    return members


def item_features(rows: np.ndarray, members: list[dict]) -> np.ndarray:
    """Rectified first item layer of every member, side by side: (rows, members x hidden)."""
    return np.hstack([np.maximum(rows @ w["item_w"].T + w["item_b"], 0.0) for w in members])


def concept_vectors(means: np.ndarray, members: list[dict]) -> np.ndarray:
    """Mean item features (sets, members x hidden) -> concept vectors, scaled so that distances are RMS."""
    parts = np.split(means, len(members), axis=1)
    outputs = []
    for mean, w in zip(parts, members):
        pooled = mean @ w["mix_w"].T + w["mix_b"]
        hidden = np.maximum(pooled @ w["set_w"].T + w["set_b"], 0.0)
        outputs.append(hidden @ w["out_w"].T + w["out_b"])
    return np.hstack(outputs) / np.sqrt(len(members))


@dataclass
class ConceptModel:
    params: ConceptParams
    mean: np.ndarray
    std: np.ndarray
    members: list[dict]
    held: DataFrame | None = None      # held-out reference rows (window_id, post_id, embedding)
    pool: bs.Pool | None = None        # the same rows, addressed for calibration draws
    thresholds: DataFrame | None = None       # (size, n_context, threshold)
    losses: list = field(default_factory=list)
    meta: dict = field(default_factory=dict)


def sub_windows(rows: DataFrame, n: int, order: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """`sub_window` 0..n-1: the window itself when there are several, else contiguous equal slices.

    Slice sizes differ by at most one, the larger slices first. The global rank works by range
    partitions, so a single huge group is never sorted in one task.
    """
    total = rows.select(F.count("*").alias("total"), F.countDistinct("window_id").alias("windows")).first()
    if total["windows"] >= 2:
        ids = sized(positions(rows, 0).select("window_id", F.col("position").alias("sub_window")))
        return rows.join(ids, "window_id")
    return equal_slices(rows, total["total"], n, order)


def equal_slices(rows: DataFrame, total: int, n: int, order: tuple[str, ...]) -> DataFrame:
    small, larger = divmod(total, max(min(n, total), 1))
    edge = larger * (small + 1)
    rank = F.col("slice_rank")
    slice_no = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - edge) / max(small, 1)))
    ranked = global_rank(rows, list(order), "slice_rank")
    return ranked.withColumn("sub_window", slice_no.cast("int")).drop("slice_rank")


def heldout_pool(held: DataFrame, width: int, seed: int) -> bs.Pool:
    """Held-out rows addressed by reference window; item features are computed where they are drawn."""
    keyed = held.withColumn("order_key", order_key(seed, "window_id", "post_id", tie="post_id"))
    return bs.make_pool(keyed.select(F.col("window_id").alias("grp"), "order_key", F.col("embedding").alias("vec")), width)


def fit_concept(reference: DataFrame, params: ConceptParams = ConceptParams(), meta: dict | None = None,
                members: list[dict] | None = None) -> ConceptModel:
    """Standardise, split every reference window into training and held-out rows, train, build the pool.

    Given `members` are used as they are, without training.
    """
    rows = reference.select("window_id", "post_id", "embedding")
    scaler = fit_scaler(rows).first()
    mean, std = np.asarray(scaler["mean"]), np.asarray(scaler["std"])
    split = cut_lineage(holdout_split(rows, params.holdout_fraction, params.seed))
    sizes = split.groupBy("is_heldout").agg(F.count("*").alias("rows")).collect()      # two rows
    counts = {r["is_heldout"]: r["rows"] for r in sizes}
    if counts.get(True, 0) < 2 or counts.get(False, 0) < 2:
        raise ValueError(f"reference set too small ({scaler['n']} vectors)")
    given, losses = members is not None, []
    members = members or init_weights(len(mean), params)
    if params.train_epochs > 0 and not given:
        from tidemark.operators.training import train_encoder

        members, losses = train_encoder(split.filter("NOT is_heldout"), mean, std, members, params)
    held = split.filter("is_heldout").drop("is_heldout")
    pool = heldout_pool(held, len(mean), params.seed)
    return ConceptModel(params, mean, std, members, held, pool, losses=losses, meta=meta or {})


def calibration_regime(counts: np.ndarray, size: int, n_context: int) -> str:
    """How calibration sets are drawn: distinct windows, disjoint pooled sets, or independent sets."""
    n_sets = n_context + 1
    if (counts >= 2 * size).sum() >= n_sets:
        return "windows"
    return "disjoint" if counts.sum() >= n_sets * size else "independent"


def drawn_sets(pool: bs.Pool, seed: int, size: int, n_context: int, draw: int) -> list[bs.Draw]:
    """The n_context + 1 sets of one calibration draw, the scored set last.

    Distinct windows in time order, or every n-th slot of one large pooled draw (disjoint sets), or a draw for each set
    (with repeats if the pool holds fewer than `size` rows).
    """
    n_sets, total = n_context + 1, pool.size
    salt, regime = f"{seed}#{size}#{n_context}#{draw}", calibration_regime(pool.counts, size, n_context)
    if regime == "windows":
        large = np.flatnonzero(pool.counts >= 2 * size)
        chosen = large[bs.distinct_choice(f"{salt}#windows", len(large), n_sets)]
        return [bs.Draw(f"{salt}#{i}", int(pool.starts[g]), int(pool.counts[g]), size, size) for i, g in enumerate(chosen)]
    if regime == "disjoint":
        return [bs.Draw(salt, 0, total, size, n_sets * size, i, n_sets) for i in range(n_sets)]
    return [bs.Draw(f"{salt}#{i}", 0, total, size, size if total >= size else 0) for i in range(n_sets)]


def calibration_scores(model: ConceptModel, keys: DataFrame) -> DataFrame:
    """Largest distance of the last of n_context + 1 in-distribution sets to the others, per draw.

    A block's share of a draw is one sum of item features for each set.
    """
    layout = bs.Pool(None, model.pool.groups, model.pool.counts, model.pool.width)       # travels without its frame
    seed, members, mean, std = model.params.seed, model.members, model.mean, model.std

    def prepare(rows: np.ndarray) -> np.ndarray:
        return item_features((rows - mean) / std, members)

    def fold(sets: list[np.ndarray], whole: bool) -> np.ndarray:
        return np.stack([s.sum(axis=0) for s in sets])

    def finish(key: dict, shares: list[np.ndarray]) -> float:
        concepts = concept_vectors(np.sum(shares, axis=0) / key["size"], members)
        return float(np.linalg.norm(concepts[:-1] - concepts[-1], axis=1).max())

    wanted = keys.select(F.col("size").cast("long").alias("size"), F.col("n_context").cast("long").alias("n_context"))
    return bs.run_draws(wanted, model.params.n_calibration, model.pool,
                        lambda key, draw: drawn_sets(layout, seed, key["size"], key["n_context"], draw), fold, finish, prepare)


def calibrate(model: ConceptModel, keys: DataFrame) -> DataFrame:
    """(size, n_context, threshold) for all keys; known keys are not drawn again."""
    known = model.thresholds
    wanted = keys.select(F.col("size").cast("long").alias("size"), F.col("n_context").cast("long").alias("n_context")).distinct()
    missing = wanted if known is None else wanted.join(known, ["size", "n_context"], "left_anti")
    fresh = bs.p_threshold(calibration_scores(model, missing), ["size", "n_context"], model.params.percentile)
    model.thresholds = settle(fresh if known is None else known.unionByName(fresh))
    return model.thresholds


def init_context(model: ConceptModel) -> DataFrame:
    """Held-out rows of the last C reference windows, sampled to the scoring size."""
    last = [int(g) for g in model.pool.groups[-model.params.context_windows:]]       # C window ids
    rows = model.held.filter(F.col("window_id").isin(last))
    return sample_per_window(rows, model.params.scoring_sample_size, model.params.seed)


def scoring_sets(stream: DataFrame, model: ConceptModel) -> DataFrame:
    """Rows of the initial context and of the stream windows, sampled, in draw order `rn`."""
    sampled = sample_per_window(stream.select("window_id", "post_id", "embedding"),
                                model.params.scoring_sample_size, model.params.seed)
    columns = ["window_id", "rn", "embedding"]
    seeded = init_context(model).select(*columns).withColumn("is_context", F.lit(True))
    return seeded.unionByName(sampled.select(*columns).withColumn("is_context", F.lit(False)))


def encode_sets(sets: DataFrame, sizes: DataFrame, model: ConceptModel) -> DataFrame:
    """Concept vector of the first `size` rows of every window, for each size it is compared at.

    `sizes` has (window_id, sizes array); one group holds at most `scoring_sample_size` rows.
    """
    shared = sets.sparkSession.sparkContext.broadcast((model.mean, model.std, model.members))

    def encode(table: pa.Table) -> pa.Table:
        mean, std, members = shared.value
        order = np.argsort(table.column("rn").to_numpy())
        features = item_features((matrix_of(table.column("embedding"))[order] - mean) / std, members)
        sizes_here = np.asarray(table.column("sizes")[0].as_py(), dtype=np.int64)
        running = np.cumsum(features, axis=0)
        concepts = concept_vectors(running[sizes_here - 1] / sizes_here[:, None], members)
        window = table.column("window_id")[0].as_py()
        return pa.table({"window_id": [window] * len(sizes_here), "size": pa.array(sizes_here),
                         "concept": pa.array(list(concepts), pa.list_(pa.float64()))})

    return sets.join(sizes, "window_id").groupBy("window_id").applyInArrow(
        encode, "window_id bigint, size bigint, concept array<double>")


def fixed_model(rows: DataFrame, params: ConceptParams) -> ConceptModel:
    """Standardisation of these vectors and the encoder of `fixed_members`; it has no thresholds."""
    scaler = fit_scaler(rows).first()
    mean, std = np.asarray(scaler["mean"]), np.asarray(scaler["std"])
    return ConceptModel(params, mean, std, fixed_members(len(mean), params))


def context_discrepancy(sets: DataFrame, model: ConceptModel) -> DataFrame:
    """Score of every window of `sets` (window_id, rn, embedding) against the windows before it, at their common size."""
    per_window = sets.groupBy("window_id").agg(F.count("*").alias("set_size"))
    placed = settle(positions(per_window, 0).drop("is_reference").join(per_window, "window_id"))
    return _discrepancies(sets, placed, context_frame(placed, model.params.context_windows), model)


def max_discrepancy(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest distance of each window to its context at the common size; lag of the first maximum.

    `pairs`: (window_id, position, context_id, context_position, size).
    """
    own = concepts.select("window_id", "size", F.col("concept").alias("own"))
    other = concepts.select(F.col("window_id").alias("context_id"), "size", F.col("concept").alias("other"))
    gaps = pairs.join(own, ["window_id", "size"]).join(other, ["context_id", "size"]).withColumn(
        "gap", vx.distance(F.col("own"), F.col("other")))
    best = F.max(F.struct("gap", (-F.col("context_position")).alias("earliest")))
    return gaps.groupBy("window_id", "position").agg(best.alias("best")).select(
        "window_id", F.col("best.gap").alias("mcddd_score"),
        (F.col("position") + F.col("best.earliest")).cast("int").alias("mcddd_lag"),
    )


def raw_scores(stream: DataFrame, model: ConceptModel, targets_only: DataFrame | None = None) -> DataFrame:
    """Per stream window: largest discrepancy, its lag, the set size used and the context length.

    With `targets_only` (window ids) the other stream windows serve as context and are not scored.
    """
    c = model.params.context_windows
    sets = cut_lineage(scoring_sets(stream, model))
    per_window = sets.groupBy("window_id", "is_context").agg(F.count("*").alias("set_size"))
    placed = settle(positions(per_window, 0).drop("is_reference").join(per_window, "window_id"))
    targets = context_frame(placed.select("window_id", "position", "set_size"), c).join(
        placed.filter("NOT is_context").select("window_id"), "window_id", "left_semi")
    if targets_only is not None:
        targets = targets.join(targets_only.select("window_id"), "window_id", "left_semi")
    return _discrepancies(sets, placed, targets, model)


def _discrepancies(sets: DataFrame, placed: DataFrame, targets: DataFrame, model: ConceptModel) -> DataFrame:
    """Largest discrepancy of every target (window_id, size, n_context) to its context windows."""
    pairs = context_pairs(placed.select("window_id", "position"), model.params.context_windows).join(
        targets.select("window_id", "size", "n_context"), "window_id")
    needed = pairs.select("window_id", "size").unionByName(pairs.select(F.col("context_id").alias("window_id"), "size"))
    sizes = needed.groupBy("window_id").agg(F.array_sort(F.collect_set("size")).alias("sizes"))   # at most C + 1 each
    concepts = cut_lineage(encode_sets(sets, sized(sizes), model))
    return targets.select("window_id", "size", "n_context").join(max_discrepancy(concepts, pairs), "window_id", "left")


def mcd_score(stream: DataFrame, model: ConceptModel, targets_only: DataFrame | None = None) -> DataFrame:
    """Score, threshold for (size, context length), alarm and lag of every stream window.

    A window without context scores 0 without an alarm.
    """
    raw = settle(raw_scores(stream, model, targets_only))
    full = min(model.params.scoring_sample_size, model.pool.size)
    keys = raw.select(
        F.when(F.col("n_context") > 0, F.col("size")).otherwise(F.lit(full)).alias("size"),
        F.when(F.col("n_context") > 0, F.col("n_context")).otherwise(F.lit(model.params.context_windows)).alias("n_context"),
    )
    thresholds = sized(calibrate(model, keys))
    keyed = raw.withColumns({
        "key_size": F.when(F.col("n_context") > 0, F.col("size")).otherwise(F.lit(full)),
        "key_context": F.when(F.col("n_context") > 0, F.col("n_context")).otherwise(F.lit(model.params.context_windows)),
    })
    limits = thresholds.select(F.col("size").alias("key_size"), F.col("n_context").alias("key_context"), "threshold")
    scored = keyed.join(limits, ["key_size", "key_context"], "left")
    score = F.coalesce("mcddd_score", F.lit(0.0))
    alarm = (F.col("n_context") > 0) & (score > F.col("threshold"))
    return scored.select(
        "window_id", sig(score).alias("mcddd_score"), F.coalesce(alarm, F.lit(False)).alias("mcddd_alarm"),
        sig(F.col("threshold")).alias("mcddd_threshold"), "mcddd_lag",
    )
