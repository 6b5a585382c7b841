import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import concept as cd, embedding as em, explain as ex, frechet as fd, windowing as wd
from tidemark.plans import scoring
from tidemark.session import shared_folder
from tidemark.sinks import models
from tidemark.sources.windows import read_json_stream, read_windows
from tidemark.streaming import progress, windows as sw
from tidemark.streaming.scoring import StreamScorer, latest_scores

ROWS = [
    ("a", "2020-04-19 14:01:00", "first post"), ("a", "2020-04-19 14:01:00", "first post"), ("b", "2020-04-19 14:10:00", "second"),
    ("c", "2020-04-19T14:20:00", "third"), ("d", "2020-04-19 14:21:00", "@user http://x.y"), ("z", "2020-04-20 00:00:00", "sentinel"),
]


def write_messages(path, rows, name="part-0.json"):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(dict(zip(("post_id", "timestamp", "text"), r), source="s")) + "\n" for r in rows))


def test_quarter_hour_windows(spark, tmp_path):
    write_messages(tmp_path / "in", ROWS)
    stream = sw.windows_stream(read_json_stream(spark, str(tmp_path / "in")), "15 minutes", "10 minutes")
    query = sw.start_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = read_windows(spark, str(tmp_path / "out")).orderBy("window_id").collect()
    assert [(r["window_start"], r["post_count"]) for r in rows] == [("2020-04-19T14:00:00", 2), ("2020-04-19T14:15:00", 1)]
    assert rows[1]["window_id"] - rows[0]["window_id"] == 1 and rows[0]["texts"] == ["first post", "second"]
    table = progress.progress_table(query)
    assert table.agg(F.max("input_rows")).first()[0] == 6
    assert table.agg(F.sum("duplicates_dropped")).first()[0] == 1


def test_day_closes_when_the_next_arrives_and_restart_continues(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        sw.start_windows(sw.windows_stream(read_json_stream(spark, str(source)), "1 day", parts=3), out, cp).awaitTermination()
        rows = read_windows(spark, out).groupBy("window_start").agg(F.sum("post_count")).collect()
        return {r[0]: r[1] for r in rows}

    write_messages(source, [("a", "2020-04-19", "one"), ("b", "2020-04-19", "two"), ("c", "2020-04-20", "three")])
    assert run() == {"2020-04-19T00:00:00": 2}
    write_messages(source, [("d", "2020-04-20 05:00:00", "four"), ("late", "2020-04-19", "late"), ("e", "2020-04-21", "five")], "part-1.json")
    assert run() == {"2020-04-19T00:00:00": 2, "2020-04-20T00:00:00": 2}
    batch = wd.window_counts(wd.posts_from_messages(spark.read.schema("post_id string, timestamp string, text string, source string")
                                                    .json(str(source)), "1 day"))
    assert batch.count() == 3                        # the batch twin also closes the open tail


def test_long_form_stream_equals_batch(spark, tmp_path):
    write_messages(tmp_path / "in", ROWS)
    parsed = read_json_stream(spark, str(tmp_path / "in"))
    query = sw.posts_stream(parsed, "15 minutes").writeStream.format("memory").queryName("long_posts").start()
    query.processAllAvailable()
    query.stop()
    batch = wd.posts_from_messages(spark.read.schema(parsed.schema).json(str(tmp_path / "in")), "15 minutes")
    columns = ["post_id", "event_time", "text", "window_id"]
    assert spark.table("long_posts").select(*columns).exceptAll(batch.select(*columns)).isEmpty()
    assert spark.table("long_posts").count() == batch.count() == 4


def test_quality_side_query(spark, tmp_path):
    write_messages(tmp_path / "in", ROWS + [("q", "not-a-date", "text")])
    sw.start_quality(read_json_stream(spark, str(tmp_path / "in")), str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination()
    row = spark.read.json(str(tmp_path / "q")).first()
    assert (row["total"], row["invalid_timestamp"], row["empty_after_cleaning"]) == (7, 1, 1)


DIM = 8
FRECHET = fd.FrechetParams(pca_components=6, n_calibration=20, window_sample_size=50)
CONCEPT = cd.ConceptParams(hidden_dim=8, output_dim=4, n_encoders=2, train_epochs=0, scoring_sample_size=40, context_windows=2, n_calibration=20)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(w, f"2000-01-{w:02d}", f"p{w}_{i}", [float(v) for v in rng.standard_normal(DIM) + (3.0 if w >= 9 else 0.0)])
            for w in range(1, 11) for i in range(60)]
    return spark.createDataFrame(rows, "window_id long, window_start string, post_id string, embedding array<float>").cache()


def test_scores_follow_the_stream_without_duplicates(spark, vectors, tmp_path):
    scorer = StreamScorer(spark, str(tmp_path / "s"), 5, FRECHET, CONCEPT)
    scorer.process(vectors.filter("window_id <= 3"), 0)
    assert not (tmp_path / "s" / "scores").exists()              # the reference is not complete yet
    scorer.process(vectors.filter("window_id BETWEEN 4 AND 7"), 1)
    StreamScorer(spark, str(tmp_path / "s"), 5, FRECHET, CONCEPT).process(vectors.filter("window_id > 7"), 2)     # a restart
    scorer.process(vectors.filter("window_id > 7"), 2)            # a retried micro-batch
    streamed = {r["window_id"]: r for r in spark.read.json(str(tmp_path / "s" / "scores")).collect()}
    assert sorted(streamed) == list(range(1, 11)) and spark.read.json(str(tmp_path / "s" / "scores")).count() == 10
    assert [streamed[w]["is_reference"] for w in (5, 6)] == [True, False] and streamed[9]["driftlens_alarm"]
    reference = scoring.reference_ids(vectors, 5)
    batch = scoring.score_windows(vectors, reference, *scoring.fit_detectors(vectors, reference, FRECHET, CONCEPT))
    for r in batch.collect():
        s = streamed[r["window_id"]]
        assert (s["driftlens_score"], s["threshold"], s["n_used"]) == pytest.approx((r["driftlens_score"], r["threshold"], r["n_used"]))
        if r["mcddd_score"] is None:
            assert s["mcddd_score"] is None
        else:
            assert (s["mcddd_score"], s["mcddd_threshold"], s["mcddd_lag"]) == pytest.approx(
                (r["mcddd_score"], r["mcddd_threshold"], r["mcddd_lag"]), rel=1e-4)


def test_a_window_that_grows_is_scored_again(spark, vectors, tmp_path):
    """Half of window 8 arrives a micro-batch later than the rest; all score columns then equal the batch run's."""
    root = str(tmp_path / "s")
    late = (F.col("window_id") == 8) & (F.substring_index("post_id", "_", -1).cast("int") >= 30)
    scorer = StreamScorer(spark, root, 5, FRECHET, CONCEPT)
    scorer.process(vectors.filter(~late & (F.col("window_id") <= 8)), 0)
    known = spark.read.parquet(models.newest(spark, f"{root}/frechet", "frechet", "hashing", [1, 2, 3, 4, 5], vars(FRECHET)) + "/model_thresholds").count()
    StreamScorer(spark, root, 5, FRECHET, CONCEPT).process(vectors.filter(late), 1)
    StreamScorer(spark, root, 5, FRECHET, CONCEPT).process(vectors.filter("window_id > 8"), 2)
    assert known >= 2                                              # a restart finds the thresholds calibrated before
    streamed = {r["window_id"]: r for r in latest_scores(spark, root).collect()}
    reference = scoring.reference_ids(vectors, 5)
    batch = scoring.score_windows(vectors, reference, *scoring.fit_detectors(vectors, reference, FRECHET, CONCEPT))
    skipped = {"processing_latency_ms", "throughput_posts_per_sec"}
    for r in batch.collect():
        for c in set(batch.columns) - skipped:
            assert streamed[r["window_id"]][c] == (pytest.approx(r[c], rel=1e-4) if isinstance(r[c], float) else r[c]), (r["window_id"], c)


def test_progress_of_a_long_run_is_kept(spark, tmp_path):
    source, collector = tmp_path / "in", progress.ProgressCollector(spark, str(tmp_path / "progress"))
    source.mkdir()
    for k in range(130):
        write_messages(source, [(f"p{k}", "2020-04-19", "x")], f"part-{k:03d}.json")
    spark.streams.addListener(collector)
    try:
        stream = read_json_stream(spark, str(source), max_files=1)
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).queryName("long").trigger(availableNow=True).start()
        q.awaitTermination()
        assert collector.drain(q) == []
        assert collector.table().filter("query = 'long' and input_rows > 0").count() == 130
    finally:
        spark.streams.removeListener(collector)


def test_micro_batches_leave_no_temporary_tables(spark, vectors, tmp_path):
    def tables():
        root = Path(shared_folder(spark).removeprefix("file:")) / f"tidemark-{spark.sparkContext.applicationId}"
        return {p.name for p in root.iterdir()} if root.exists() else set()

    before = tables()
    StreamScorer(spark, str(tmp_path / "s"), 5, FRECHET, None).process(vectors, 0)
    assert tables() == before and spark.read.json(str(tmp_path / "s" / "scores")).count() == 10


def test_models_are_reused_only_when_everything_matches(spark, vectors, tmp_path):
    path, ids = str(tmp_path / "m"), [1, 2, 3, 4, 5]
    reference = vectors.filter("window_id <= 5")
    model = cd.fit_concept(reference, CONCEPT)
    keys = spark.createDataFrame([(40, 2)], "size long, n_context long")
    known = cd.calibrate(model, keys).first()["threshold"]
    assert models.load_concept_if_matching(spark, path, "m", ids, CONCEPT) is None
    models.save_concept(model, path, "m", ids)
    loaded = models.load_concept_if_matching(spark, path, "m", ids, CONCEPT)
    assert np.allclose(loaded.members[1]["out_w"], model.members[1]["out_w"]) and np.allclose(loaded.std, model.std)
    assert loaded.thresholds.first()["threshold"] == known
    fresh = cd.mcd_score(vectors.filter("window_id > 5"), model).orderBy("window_id").collect()
    assert cd.mcd_score(vectors.filter("window_id > 5"), loaded).orderBy("window_id").collect() == fresh
    assert models.load_concept_if_matching(spark, path, "other", ids, CONCEPT) is None
    assert models.load_concept_if_matching(spark, path, "m", ids[:4], CONCEPT) is None
    assert models.load_concept_if_matching(spark, path, "m", ids, cd.ConceptParams()) is None


def test_first_window_without_context_scores_zero(spark, vectors):
    """A stream before any reference window in time: nothing to compare with."""
    model = cd.fit_concept(vectors.filter("window_id BETWEEN 4 AND 8"), CONCEPT)
    row = cd.mcd_score(vectors.filter("window_id = 1"), model).first()
    assert (row["mcddd_score"], row["mcddd_alarm"], row["mcddd_lag"]) == (0.0, False, None) and row["mcddd_threshold"] > 0


def test_embeddings(spark, tmp_path):
    posts = spark.createDataFrame([("a", "vaccine dose queue"), ("b", "vaccine dose queue"), ("c", "??")], "post_id string, text string")
    rows = {r["post_id"]: np.array(r["embedding"]) for r in em.embed(posts, 32).collect()}
    assert np.linalg.norm(rows["a"]) == pytest.approx(1, abs=1e-6) and (rows["a"] == rows["b"]).all() and not rows["c"].any()

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = {r["post_id"]: r["embedding"] for r in em.embed_with(posts, factory).collect()}
    assert np.allclose(own["c"], np.array([2, 1]) / np.sqrt(5))
    cached = em.embed_cached(posts, str(tmp_path / "e"), "m", lambda df: em.embed(df, 32))
    assert cached.count() == 3 and spark.read.parquet(str(tmp_path / "e")).count() == 2
    em.embed_cached(posts, str(tmp_path / "e"), "m", lambda df: em.embed(df, 32))
    missing = em.embed_cached(spark.createDataFrame([("d", None), ("e", "dose")], "post_id string, text string"), str(tmp_path / "n"), "m", lambda df: em.embed(df, 32))
    assert {r["post_id"]: any(r["embedding"]) for r in missing.collect()} == {"d": False, "e": True}
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_representatives(spark, vectors):
    rows = ex.centroid_k(vectors.filter("window_id = 1").select("window_id", "post_id", "embedding"), 3).orderBy("rank").collect()
    x = {r["post_id"]: np.array(r["embedding"]) for r in vectors.filter("window_id = 1").collect()}
    centre = np.mean(list(x.values()), axis=0)
    best = sorted(x, key=lambda p: -x[p] @ centre / np.linalg.norm(x[p]))[:3]
    assert [r["post_id"] for r in rows] == best


def test_streamed_windows_keep_no_texts_in_state(spark, tmp_path, monkeypatch):
    """State holds ids only; posts wait in files until their window closes, then leave; a large window comes in parts."""
    monkeypatch.setattr(wd.nested_windows, "__defaults__", (3, 1 << 20))
    source, out = tmp_path / "in", tmp_path / "out"

    def run():
        query = sw.start_windows(sw.windows_stream(read_json_stream(spark, str(source)), "1 day"), str(out), str(tmp_path / "cp"))
        query.awaitTermination()
        return query

    def waiting():
        return sorted(spark.read.parquet(str(out / "_open")).filter("text is not null").toPandas()["post_id"])

    first = [(f"a{k}", f"2020-04-19 10:00:0{k}", f"text {k} " + "x" * 10_000) for k in range(8)]
    write_messages(source, first + [("b0", "2020-04-20 01:00:00", "next day")])
    state = [o for p in run().recentProgress for o in json.loads(p.json)["stateOperators"]]
    assert {o["operatorName"] for o in state} == {"dedupe"} and max(o["memoryUsedBytes"] for o in state) < 8 * 10_000
    rows = read_windows(spark, str(out)).orderBy("part").collect()
    assert [(r["part"], r["part_offset"], r["post_count"], r["post_ids"]) for r in rows] == [
        (0, 0, 8, ["a0", "a1", "a2"]), (1, 3, 8, ["a3", "a4", "a5"]), (2, 6, 8, ["a6", "a7"])]
    write_messages(source, [("b1", "2020-04-20 00:30:00", "late"), ("b2", "2020-04-20 02:00:00", "more"), ("c0", "2020-04-21", "end")], "part-1.json")
    run()
    assert waiting() == ["c0"]
    assert {r["post_ids"][0]: r["texts"][1:] for r in read_windows(spark, str(out)).filter("post_count = 2").collect()} == {"b0": ["more"]}
