import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring as sc, timestamps as ts
from tidemark.operators import compare as cmp, evaluate as ev, explain as ex, injection as inj
from tidemark.schemas import SCORE_INPUT
from tidemark.sinks import metrics
from tidemark.sources import scores as src

COLUMNS = ("scenario string, position int, window_id long, window_start string, driftlens_score double, driftlens_alarm boolean, "
           "threshold double, mcddd_score double, mcddd_alarm boolean, mcddd_threshold double, mcddd_lag int, n_posts long, "
           "n_used long, is_reference boolean, processing_latency_ms double, throughput_posts_per_sec double")


def stream(scenario, first, second, n=60, n_ref=14):
    """Score rows with alarms at the given positions."""
    rows = []
    for p in range(n):
        a, b, ref = p in first, p in second, p < n_ref
        rows.append((scenario, p, 10957 + p, f"2000-{1 + p // 28:02d}-{1 + p % 28:02d}T00:00:00", 0.05 if a else 0.02, a, 0.04,
                     None if ref else (1.5 if b else 0.5), None if ref else b, None if ref else 1.0, None if ref else 3,
                     1000, 1000, ref, 10.0 + p, 100.0))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    """The published alarms of two scenarios: A from the change on, B on nine windows after it."""
    return spark.createDataFrame(
        stream("sudden", set(range(30, 60)), set(range(31, 40))) + stream("volume", {50}, set()), COLUMNS).cache()


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("sudden", True, 30, 30, None, None), ("volume", False, None, None, 30, 3)],
                                 "scenario string, concept_drift boolean, drift_start int, drift_end int, volume_change int, volume_factor int")


def test_published_quality_numbers(scored, truth):
    labelled = ev.label_windows(scored, truth, 14)
    rows = {(r["scenario"], r["detector"]): r for r in ev.detector_metrics(labelled, 14).collect()}
    a, b, v = rows["sudden", "driftlens"], rows["sudden", "mcddd"], rows["volume", "driftlens"]
    assert (a["precision"], a["recall"], a["f1"], a["detection_delay"]) == (1.0, 1.0, 1.0, 0)
    assert (b["precision"], b["recall"], round(b["f1"], 3), b["detection_delay"]) == (1.0, 0.3, 0.462, 1)
    assert round(v["false_alarm_rate"], 4) == 0.0217 and v["recall"] == 0.0 and v["detection_delay"] is None
    rates = {r["scenario"]: r for r in ev.agreement_matrix(scored, 14).collect()}
    assert round(rates["sudden"]["agreement_rate"], 3) == 0.543 and round(rates["volume"]["agreement_rate"], 3) == 0.978
    wide = {r["scenario"]: r for r in ev.side_by_side(ev.detector_metrics(labelled, 14), ev.agreement_matrix(scored, 14)).collect()}
    assert wide["sudden"]["mcddd_recall"] == 0.3 and wide["sudden"]["driftlens_detection_delay"] == 0


def test_summary_cells(scored, truth):
    metrics_ = ev.scenario_metrics(ev.label_windows(scored, truth, 14), 14)
    cells = {(r["scenario"], r["detector"]): r for r in ev.summary_rows(metrics_, truth).collect()}
    b, v = cells["sudden", "mcddd"], cells["volume", "driftlens"]
    assert (b["expected"], b["stream_alarms"], b["false_alarms"], b["first_alarm"], b["alarm_rate_after"]) == (
        "drift at 30", "9/46", "0 (0%)", "31 (+1)", "30%")
    assert (v["expected"], v["false_alarms"], v["first_alarm"], v["alarm_rate_after"]) == (
        "no drift (volume x3 at 30)", "0%", "-", "3% (any alarm is false)")
    assert ev.markdown(ev.summary_rows(metrics_, truth)).count() == 4


def test_delay_and_false_alarms_with_tolerance(spark):
    scored = spark.createDataFrame(stream("s", {6, 10}, set(), n=20, n_ref=5), COLUMNS)
    truth = spark.createDataFrame([("s", True, 8, 8, None, None)],
                                  "scenario string, concept_drift boolean, drift_start int, drift_end int, volume_change int, volume_factor int")
    rows = {r["detector"]: r for r in ev.scenario_metrics(ev.label_windows(scored, truth, 5), 5, 3).collect()}
    a = rows["driftlens"]
    assert (a["false_alarms_before_drift"], a["detection_delay"], a["detected_within_tolerance"]) == (1, 2, True)
    assert a["alarm_positions"] == [6, 10] and rows["mcddd"]["detected_within_tolerance"] is False


def test_seed_spread(spark):
    runs = spark.createDataFrame([("g", i, a, f, d, d) for i, (a, f, d) in enumerate([(5, 0, 1), (6, 0, 0), (8, 1, 2), (7, 0, None)])] +
                                 [("q", 0, 1, None, None, None)],
                                 "scenario string, seed int, alarms int, false_alarms_before_drift int, detection_delay int, first_alarm_after_drift int")
    rows = {r["scenario"]: r for r in ev.seed_spread(runs).collect()}
    assert rows["g"]["stream_alarms"] == "6.5 [5-8]" and rows["g"]["first_alarm_delay"] == "1 [0-2]" and rows["g"]["detected_runs"] == "3/4"
    assert rows["q"]["false_alarms"] == "1 [1-1] (all false)" and rows["q"]["detected_runs"] == "-"


def score_rows(spark, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in SCORE_INPUT.fields} for r in rows], SCORE_INPUT)


BASE = {"window_id": 1, "window_start": "2020-05-03T00:00:00", "driftlens_score": 0.0471, "driftlens_alarm": True, "threshold": 0.02,
        "mcddd_score": 0.68, "mcddd_alarm": True, "mcddd_threshold": 0.54, "mcddd_lag": 2, "n_posts": 1000, "n_used": 1000,
        "processing_latency_ms": 100.0}


def test_agreement_classes_and_ratios(spark):
    flags = [(True, True, True), (False, True, None), (False, True, True), (False, True, False), (False, False, True), (False, False, False)]
    df = spark.createDataFrame(flags, "r boolean, a boolean, b boolean")
    got = df.select(sc.classify_agreement(F.col("r"), F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == ["reference", "mcddd_missing", "both", "driftlens_only", "mcddd_only", "neither"]
    row = cmp.normalise_scores(score_rows(spark, BASE)).first()
    assert (row["agreement"], row["agreement_code"]) == ("both", 4)
    assert row["driftlens_ratio"] == 2.355 and row["mcddd_ratio"] == 1.2593
    assert row["throughput_posts_per_sec"] == 10000.0
    zero = cmp.normalise_scores(score_rows(spark, {**BASE, "threshold": 0.0, "mcddd_score": None})).first()
    assert zero["driftlens_ratio"] is None and zero["mcddd_ratio"] is None
    unknown = spark.createDataFrame([("odd",)], "a string").select(sc.agreement_code(F.col("a"))).first()[0]
    assert unknown == 1


def test_line_protocol(spark):
    row = {**BASE, "driftlens_alarm": False, "driftlens_score": 0.0005, "agreement": None}
    line = metrics.to_line_protocol(cmp.normalise_scores(score_rows(spark, row))).first()["line"]
    assert line == ("drift_metrics,pipeline=cdd-stream,window_id=1,agreement=mcddd_only,driftlens_alarm_state=normal,is_reference=false,"
                    "mcddd_alarm_state=drift driftlens_score=0.0005,driftlens_alarm=0i,agreement_code=3i,processing_latency_ms=100.0,"
                    "throughput_posts_per_sec=10000.0,driftlens_threshold=0.02,driftlens_ratio=0.025,mcddd_score=0.68,mcddd_threshold=0.54,"
                    "mcddd_alarm=1i,mcddd_ratio=1.2593,mcddd_lag=2i,post_count=1000i,n_posts=1000i,n_used=1000i 1588464000")
    flat = metrics.to_flat(cmp.normalise_scores(score_rows(spark, row))).first()
    assert flat["timestamp"] == "2020-05-03T00:00:00+00:00" and flat["cpu_pct"] == "" and flat["mcddd_alarm"] == "1"
    assert len(flat) == 19


@pytest.mark.parametrize("value", [0.0, 0.5, 1.0, 123.456, 0.00012, 0.0009, 0.00001, 1.23456e-07, 12345678.0, 1.5e17, 123456789.25])
def test_number_text_is_the_shortest_decimal(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(sc.float_text(F.col("v"))).first()[0]
    assert got == repr(value)


def test_significant_digits(spark):
    values = [0.0, 1.234567891e-7, 123456789.0, 0.1, 1.92705]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sc.sig(F.col("v"))).collect()]
    assert got == [float(f"{v:.6g}") for v in values]


def test_timestamps_normalise(spark):
    values = ["1588464000", "2020-05-03T00:00:00Z", "2020-05-03", "2020-05-03T02:00:00+02:00", "2020-05-03 00:00:00", "nonsense", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(F.unix_seconds(ts.normalise_ts(F.col("v")))).collect()]
    assert got == [1588464000] * 5 + [None, None]


def test_rejects_have_a_reason(spark):
    rows = [{k: v for k, v in BASE.items() if k != missing} for missing in ("window_id", "driftlens_score", "driftlens_alarm", "window_start")]
    _, bad = cmp.validate_scores(score_rows(spark, *rows, BASE))
    assert sorted(r["reject_reason"] for r in bad.collect()) == [
        "missing driftlens_alarm", "missing driftlens_score", "missing timestamp", "missing window_id"]


def test_delivery_writes_every_window_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    records = cmp.normalise_scores(score_rows(spark, BASE, BASE, {**BASE, "window_id": 2}))
    metrics.deliver(records, path, 1)
    metrics.deliver(records.unionByName(cmp.normalise_scores(score_rows(spark, {**BASE, "window_id": 3}))), path, 2)
    metrics.deliver(records, path, 1)
    stored = spark.read.option("header", True).csv(path)
    assert sorted(int(r["window_id"]) for r in stored.collect()) == [1, 2, 3]


def test_priority_windows(spark):
    df = spark.createDataFrame(stream("s", {15, 16, 20, 21, 22, 23, 24, 25, 30, 31, 32, 33}, {15, 16, 20, 21, 22, 40}), COLUMNS)
    chosen = {(r["reason"], r["window_id"] - 10957) for r in cmp.select_important(cmp.compare(df)).collect()}
    assert ("mcddd_only_disagreement", 40) in chosen and ("consensus_normal_benchmark", 14) in chosen
    assert {p for why, p in chosen if why == "consensus_major_drift"} == {15, 16, 20, 21}
    assert {p for why, p in chosen if why == "driftlens_only_gradual_drift"} == {23, 24, 25}


def test_keyword_shift_and_explanation(spark):
    before = ["quarantine at home", "lockdown and quarantine", "stay home lockdown", "quarantine 2020 lockdown"]
    after = ["vaccine dose today", "second dose vaccine", "vaccine queue", "dose of vaccine"]
    rows = [(w, f"p{w}{i}", t) for w, texts in ((10971, before), (10972, after)) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "window_id long, post_id string, text string").withColumn("event_time", F.lit(0).cast("timestamp"))
    scores = spark.createDataFrame(stream("s", {15}, {15})[14:16], COLUMNS)
    shifts = ex.keyword_shift(posts, ex.window_pairs(cmp.compare(scores))).collect()
    emerging = [r["term"] for r in sorted(shifts, key=lambda r: r["rank"]) if r["direction"] == "emerging"]
    fading = [r["term"] for r in sorted(shifts, key=lambda r: r["rank"]) if r["direction"] == "fading"]
    assert emerging == ["vaccine", "dose"] and fading[:2] == ["lockdown", "quarantine"] and "2020" not in fading
    row = ex.explain(scores, posts).filter("window_id = 10972").first()
    assert row["change_type"] == "abrupt" and row["before_window_id"] == 10971 and row["after_examples"][0] == "vaccine dose today"
    assert row["detector_rationale"].startswith("Both detectors agreed on drift. DriftLens FDD score (0.0500) exceeded its threshold by 25.0%")
    assert row["emerging_keywords"][0]["score"] == 100.0
    missing = ex.explain(scores, posts.filter("window_id = 10971")).filter("window_id = 10972").first()
    assert missing["post_data_available"] is False and missing["semantic_summary"].startswith("DATA DEPENDENCY NOTICE")


def test_ground_truth_files(spark, tmp_path):
    truth = {"concept_drift": True, "drift_start": {"position": 30, "window_id": 1, "window_start": "x"},
             "drift_end": {"position": 45, "window_id": 2, "window_start": "y"}, "volume_change": None}
    (tmp_path / "gradual.json").write_text(json.dumps({"scenario": "gradual", "ground_truth": truth}, indent=2))
    row = src.read_ground_truth(spark, str(tmp_path)).first()
    assert (row["scenario"], row["drift_start"], row["drift_end"], row["volume_change"]) == ("gradual", 30, 45, None)


def test_score_files_skip_blank_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps(BASE) + "\n\n" + json.dumps({**BASE, "window_id": 2}) + "\n")
    assert src.read_scores(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps(BASE) + "\n{cut\n")
    corrupt = src.read_scores(spark, str(tmp_path / "bad.jsonl"), "corrupt")
    assert [r["corrupt"] for r in corrupt.collect() if r["corrupt"]] == ["{cut"]


PARAMS = inj.StreamParams(n_windows=20, reference_windows=5, window_size=10, change_point=8, gradual_length=4, volume_factor=3)


@pytest.fixture(scope="module")
def pools(spark):
    n = F.col("id")
    rows = spark.range(1604).select(
        F.when(n < 802, 0).otherwise(1).cast("long").alias("window_id"), F.concat(F.lit("p"), n.cast("string")).alias("post_id"),
        F.concat(F.lit("text "), F.when(n % 802 == 801, n - 1).otherwise(n).cast("string")).alias("text"), F.lit(0).cast("timestamp").alias("event_time"))
    built = inj.build_pool(rows).withColumn("pool", F.when(F.col("source_window_id") == 0, "old").otherwise("new"))
    return built.cache()


def test_pools_hold_distinct_texts(pools):
    assert {r["pool"]: r["count"] for r in pools.groupBy("pool").count().collect()} == {"old": 801, "new": 801}


def test_injected_streams_follow_the_plan(spark, pools):
    plan = inj.injection_plan(spark, PARAMS)
    rows = inj.inject_drift(pools, plan, PARAMS).cache()
    assert rows.groupBy("scenario", "post_id").count().filter("count > 1").count() == 0
    got = {(r["scenario"], r["position"]): (r["n_old"], r["n_new"]) for r in inj.composition(rows).collect()}
    want = {(r["scenario"], r["position"]): (r["n_old"], r["n_new"]) for r in plan.collect()}
    assert got == want
    assert [want["gradual", p][1] for p in range(7, 14)] == [0, 2, 4, 6, 8, 10, 10]
    assert want["sudden", 7] == (10, 0) and want["sudden", 8] == (0, 10) and want["volume", 8] == (30, 0)
    again = inj.inject_drift(pools, plan, PARAMS)
    columns = ["scenario", "position", "post_id"]
    assert rows.select(*columns).exceptAll(again.select(*columns)).isEmpty()
    ids = [r["window_id"] for r in rows.filter("scenario = 'sudden'").select("window_id").distinct().orderBy("window_id").collect()]
    assert ids == list(range(10957, 10977))
    nested = inj.injected_windows(rows).filter("scenario = 'volume' AND position = 8").first()
    assert nested["post_count"] == 30 and len(nested["timestamps"]) == 30 and nested["window_start"] == "2000-01-09T00:00:00"


def test_exhausted_pool_and_bad_params(spark, pools):
    large = inj.StreamParams(**{**vars(PARAMS), "window_size": 60})
    with pytest.raises(ValueError, match="the plan draws"):
        inj.inject_drift(pools, inj.injection_plan(spark, large), large)
    with pytest.raises(ValueError):
        inj.check_params(inj.StreamParams(**{**vars(PARAMS), "change_point": 4}))
    with pytest.raises(ValueError):
        inj.check_params(PARAMS, 14)


def test_ground_truth_and_index(spark, pools):
    truth = {r["scenario"]: r for r in inj.ground_truth(spark, PARAMS).collect()}
    assert truth["gradual"]["drift_end"]["position"] == 12 and truth["gradual"]["drift_start"]["window_id"] == 10965
    assert truth["volume"]["volume_change"]["factor"] == 3 and truth["no_drift"]["expected_alarm_windows"] == "none"
    assert truth["sudden"]["expected_alarm_windows"] == "positions 8-19"
    rows = inj.inject_drift(pools, inj.injection_plan(spark, PARAMS), PARAMS)
    index = {r["scenario"]: r for r in inj.scenario_index(inj.composition(rows), inj.ground_truth(spark, PARAMS)).collect()}
    assert (index["volume"]["n_windows"], index["volume"]["n_posts"], index["volume"]["volume_change_position"]) == (20, 440, 8)


def test_injected_parts_are_stretches_of_the_order(spark):
    """A window above a bound goes on in parts: together they are the unparted window, and none exceeds the bound."""
    rows = [("volume", 8, "stream", 20, "2020-01-21", "2020-01-22", f"p{k}", f"text {k}", f"{(k * 37) % 101:03d}") for k in range(45)]
    rows += [("volume", 9, "stream", 21, "2020-01-22", "2020-01-23", f"q{k}", "t", f"{k:03d}") for k in range(3)]
    frame = spark.createDataFrame(rows, "scenario string, position int, phase string, window_id long, window_start string, window_end string, post_id string, text string, order_key string")
    whole = {r["position"]: r for r in inj.injected_windows(frame).collect()}
    assert all(r["part"] == r["part_offset"] == 0 for r in whole.values()) and whole[8]["post_count"] == 45
    for bound, most in (({"max_part_rows": 10}, 10), ({"max_part_bytes": 70}, 10)):
        parts = {}
        for r in inj.injected_windows(frame, **bound).collect():
            parts.setdefault(r["position"], {})[r["part"]] = r
        for position, by_part in parts.items():
            texts, ids = [], []
            for k in range(len(by_part)):
                assert by_part[k]["part_offset"] == len(ids) and len(by_part[k]["post_ids"]) <= most
                assert by_part[k]["post_count"] == whole[position]["post_count"]
                texts, ids = texts + by_part[k]["texts"], ids + by_part[k]["post_ids"]
            assert (texts, ids) == (whole[position]["texts"], whole[position]["post_ids"])
        assert len(parts[8]) == 5 and len(parts[9]) == 1


def test_pools_of_several_periods_need_no_deduplicated_posts(spark):
    day = "2024-01-{:02d} 00:00:00"
    rows = [(d, day.format(d), f"{day.format(d)[:11]}0{i}:00:00", f"p{d}_{i}", text)
            for d in range(1, 7) for i, text in enumerate(["a", "b ", f"only {d}", " "])]
    schema = "window_id int, window_start string, event_time string, post_id string, text string"
    posts = spark.createDataFrame(rows + rows[:9], schema)
    periods = {"old": ("2024-01-01", "2024-01-03"), "new": ("2024-01-03", "2024-01-05")}       # day 3 lies in both
    found = {tuple(r) for r in inj.build_pools(posts, periods).select("pool", "text", "post_id", "source_window_id").collect()}
    apart = set()
    for name, period in periods.items():
        pool = inj.build_pool(spark.createDataFrame(rows, schema), *period).withColumn("pool", F.lit(name))
        apart |= {tuple(r) for r in pool.select("pool", "text", "post_id", "source_window_id").collect()}
    assert found == apart and len(found) == 10
