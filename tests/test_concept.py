import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs, concept as cd, training as tr
from tidemark.operators.layers import flat_weights, from_flat

DIM = 24
FAST = cd.ConceptParams(hidden_dim=16, output_dim=8, n_encoders=3, train_epochs=0, scoring_sample_size=100,
                        context_windows=4, n_calibration=80, sample_set_size=20, k_pairs=3, seed=3)


def unit(rng, n, shift=0.0):
    x = rng.standard_normal((n, DIM))
    x[:, 0] += shift
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def model(frame):
    rng = np.random.default_rng(0)
    return cd.fit_concept(frame({w: unit(rng, 300) for w in range(10)}), FAST)


def brute_force(model, windows: dict[int, np.ndarray]):
    """NumPy twin of the score for windows whose rows all fit the sample (order does not matter then)."""
    concepts = {w: cd.concept_vectors(cd.item_features((np.float32(x).astype(float) - model.mean) / model.std, model.members)
                                      .mean(axis=0, keepdims=True), model.members)[0] for w, x in windows.items()}
    return concepts


def test_mean_then_mix_equals_per_item_encoding(model):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, DIM))
    w = model.members[0]
    items = np.maximum(x @ w["item_w"].T + w["item_b"], 0) @ w["mix_w"].T + w["mix_b"]
    pooled = items.mean(axis=0, keepdims=True)
    expected = np.maximum(pooled @ w["set_w"].T + w["set_b"], 0) @ w["out_w"].T + w["out_b"]
    got = cd.concept_vectors(cd.item_features(x, [w]).mean(axis=0, keepdims=True), [w])
    assert np.allclose(got, expected)


def test_scores_match_numpy(model, frame):
    rng = np.random.default_rng(2)
    stream = {100 + i: unit(rng, 100, 0.3 * i) for i in range(6)}
    rows = {r["window_id"]: r for r in cd.raw_scores(frame(stream), model).collect()}
    concepts = brute_force(model, stream)
    for target in (104, 105):                    # their whole context lies in the stream
        gaps = [np.linalg.norm(concepts[target] - concepts[c]) for c in range(target - 4, target)]
        assert rows[target]["mcddd_score"] == pytest.approx(max(gaps), rel=1e-6)
        assert rows[target]["mcddd_lag"] == 4 - int(np.argmax(gaps))
        assert rows[target]["n_context"] == 4 and rows[target]["size"] == 100


def test_common_size_is_the_smallest_in_the_frame(model, frame):
    rng = np.random.default_rng(3)
    stream = {100 + i: unit(rng, n) for i, n in enumerate((150, 40, 90, 300, 80, 70, 100))}
    sizes = {r["window_id"]: r["size"] for r in cd.raw_scores(frame(stream), model).collect()}
    assert [sizes[100 + i] for i in range(7)] == [100, 40, 40, 40, 40, 40, 70]


def test_quiet_without_drift_and_alarm_on_shift(model, frame):
    rng = np.random.default_rng(4)
    stream = {100 + i: unit(rng, 300) for i in range(15)}
    quiet = cd.mcd_score(frame(stream), model)
    assert quiet.filter("mcddd_alarm").count() <= 2
    stream[115] = unit(rng, 300, 4.0)
    last = cd.mcd_score(frame(stream), model).filter("window_id = 115").first()
    assert last["mcddd_alarm"] and last["mcddd_score"] > last["mcddd_threshold"] > 0


def test_gradual_drift_is_seen_through_the_context(model, frame):
    rng = np.random.default_rng(5)
    stream = {100 + i: np.vstack([unit(rng, 300 - 30 * (i + 1)), unit(rng, 30 * (i + 1), 4.0)]) for i in range(10)}
    assert cd.mcd_score(frame(stream), model).filter("mcddd_alarm").count() > 0


def test_volume_does_not_change_the_threshold(model, frame):
    rng = np.random.default_rng(6)
    rows = {r["window_id"]: r for r in cd.mcd_score(frame({100: unit(rng, 150), 101: unit(rng, 900)}), model).collect()}
    assert rows[100]["mcddd_threshold"] == rows[101]["mcddd_threshold"]


def test_scores_do_not_depend_on_the_blocks(model, spark):
    """All three regimes, with the pool in one block and in many."""
    keys = spark.createDataFrame([(50, 4), (300, 4), (900, 4)], "size bigint, n_context bigint")
    regimes = [cd.calibration_regime(model.pool.counts, s, 4) for s in (50, 300, 900)]
    assert regimes == ["windows", "disjoint", "independent"]
    small = cd.ConceptModel(**{**vars(model), "params": cd.ConceptParams(**{**vars(FAST), "n_calibration": 6})})
    near = {(r["size"], r["draw"]): r["statistic"] for r in cd.calibration_scores(small, keys).collect()}
    pool = bs.Pool(model.pool.frame, model.pool.groups, model.pool.counts, model.pool.width, block_rows=97)
    far = {(r["size"], r["draw"]): r["statistic"] for r in cd.calibration_scores(
        cd.ConceptModel(**{**vars(small), "pool": pool}), keys).collect()}
    assert near.keys() == far.keys() and len(near) == 18
    assert all(near[k] == pytest.approx(far[k], rel=1e-4, abs=1e-6) for k in near)


def test_drawn_sets_are_disjoint_or_of_different_windows(model):
    total, seed = model.pool.size, FAST.seed
    for draw in range(10):
        rows = np.concatenate([s.positions(0, total) for s in cd.drawn_sets(model.pool, seed, 300, 4, draw)])
        assert len(rows) == len(np.unique(rows)) == 1500
        sets = cd.drawn_sets(model.pool, seed, 50, 4, draw)
        assert len({s.first for s in sets}) == 5 and [s.first for s in sets] == sorted(s.first for s in sets)


def test_slices(spark, frame):
    rng = np.random.default_rng(7)
    sliced = cd.sub_windows(frame({1: rng.standard_normal((103, 2))}), 5)
    assert [r["count"] for r in sliced.groupBy("sub_window").count().orderBy("sub_window").collect()] == [21, 21, 21, 20, 20]
    tiny = cd.sub_windows(frame({1: rng.standard_normal((3, 2))}), 5)
    assert tiny.count() == 3 and tiny.select("sub_window").distinct().count() == 3


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(8)
    params = cd.ConceptParams(hidden_dim=5, output_dim=3, n_encoders=2, lambda_gp=0.7)
    members = cd.init_weights(4, params)
    sets = rng.standard_normal((4, 6, 4))
    direction = rng.standard_normal((1, 6))
    direction /= np.linalg.norm(direction)
    values = flat_weights(members)
    loss, grads = tr.pair_gradient(sets, members, direction, params)
    flat = flat_weights(grads)
    for i in rng.choice(len(values), 60, replace=False):
        step = np.zeros_like(values)
        step[i] = 1e-6
        up = tr.pair_gradient(sets, from_flat(values + step, members), direction, params)[0]
        down = tr.pair_gradient(sets, from_flat(values - step, members), direction, params)[0]
        assert flat[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_training_lowers_the_loss_on_both_paths(spark, frame):
    rng = np.random.default_rng(9)
    params = cd.ConceptParams(**{**vars(FAST), "train_epochs": 6, "lr": 0.01})
    rows = frame({w: unit(rng, 60, 0.5 * w) for w in range(4)})
    members = cd.init_weights(DIM, params)
    mean, std = np.zeros(DIM), np.full(DIM, 0.2)
    pool = tr.training_pool(cd.sub_windows(rows, 5), mean, std, params.seed)
    _, near = tr.train_encoder(rows, mean, std, members, params, pool)
    assert near[-1] < near[0]
    far_pool = tr.TrainingPool(pool.frame, pool.groups, pool.counts, pool.width, limit=0)
    two = cd.ConceptParams(**{**vars(params), "train_epochs": 2})
    _, far = tr.train_encoder(rows, mean, std, members, two, far_pool)
    assert np.allclose(near[:2], far)


@pytest.mark.parametrize("limit", [0, tr.BROADCAST_BYTES])
def test_a_step_sends_one_gradient_to_the_driver(spark, frame, monkeypatch, limit):
    rng = np.random.default_rng(9)
    params = cd.ConceptParams(**{**vars(FAST), "train_epochs": 1})
    rows, mean, std = frame({w: unit(rng, 40, 0.5 * w) for w in range(4)}), np.zeros(DIM), np.full(DIM, 0.2)
    pool = tr.training_pool(cd.sub_windows(rows, 5), mean, std, params.seed)
    pool = tr.TrainingPool(pool.frame, pool.groups, pool.counts, pool.width, limit=limit)
    kind, collected = type(pool.frame), []
    collect = kind.collect

    def counted(self):
        found = collect(self)
        collected.extend(len(r["gradient"]) for r in found if "gradient" in self.columns)
        return found

    monkeypatch.setattr(kind, "collect", counted)
    members = cd.init_weights(DIM, params)
    tr.step_gradient(pool, members, 0, params, 4)
    assert collected == [flat_weights(members).nbytes]


def test_too_small_reference(frame):
    with pytest.raises(ValueError):
        cd.fit_concept(frame({1: np.zeros((1, DIM))}), FAST)

