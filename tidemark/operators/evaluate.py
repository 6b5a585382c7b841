"""Alarms against ground truth, for all scenarios in one grouped job.

Input `scored`: score rows with `scenario` and 0-based `position`. Input `truth`: one row per scenario
(`concept_drift, drift_start, drift_end, volume_change`).
"""
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import scoring

DETECTORS = ("driftlens", "mcddd")


def _alarm(detector: str) -> Column:
    return F.coalesce(F.col(f"{detector}_alarm"), F.lit(False))


def safe_rate(part: Column, whole: Column) -> Column:
    """0/0 counts as 0.0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def label_windows(scored: DataFrame, truth: DataFrame, n_reference: int) -> DataFrame:
    """Score rows with the drift label: stream windows at or after the drift start."""
    labels = truth.select("scenario", "concept_drift", "drift_start", "drift_end", "volume_change")
    drifting = F.col("concept_drift") & (F.col("position") >= F.col("drift_start")) & (F.col("position") >= n_reference)
    return scored.join(labels, "scenario").withColumn("ground_truth_drift", F.coalesce(drifting, F.lit(False)))


def per_detector(labelled: DataFrame) -> DataFrame:
    """Long form: one row per (window, detector) with `alarm`."""
    entries = F.array(*[F.struct(F.lit(d).alias("detector"), _alarm(d).alias("alarm")) for d in DETECTORS])
    return labelled.withColumn("entry", F.explode(entries)).withColumns({
        "detector": F.col("entry.detector"), "alarm": F.col("entry.alarm"),
    }).drop("entry")


def classification_metrics(labelled: DataFrame, n_reference: int) -> DataFrame:
    """Confusion counts, precision, recall, F1 and false-alarm rate per scenario and detector."""
    stream = per_detector(labelled).filter(F.col("position") >= n_reference)
    true, alarm = F.col("ground_truth_drift"), F.col("alarm")
    counts = stream.groupBy("scenario", "detector").agg(
        F.count_if(true & alarm).alias("TP"), F.count_if(~true & ~alarm).alias("TN"),
        F.count_if(~true & alarm).alias("FP"), F.count_if(true & ~alarm).alias("FN"),
        F.count("*").alias("stream_windows"),
    )
    rates = counts.withColumns({
        "precision": safe_rate(F.col("TP"), F.col("TP") + F.col("FP")),
        "recall": safe_rate(F.col("TP"), F.col("TP") + F.col("FN")),
        "false_alarm_rate": safe_rate(F.col("FP"), F.col("FP") + F.col("TN")),
    })
    product, total = F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")
    return rates.withColumn("f1", safe_rate(product, total))


def detection_delay(labelled: DataFrame) -> DataFrame:
    """First alarm at or after the drift start and its distance; NULL where there is none."""
    hit = F.col("concept_drift") & F.col("alarm") & (F.col("position") >= F.col("drift_start"))
    firsts = per_detector(labelled).groupBy("scenario", "detector").agg(
        F.min(F.when(hit, F.col("position"))).alias("first_alarm_position"),
        F.max("drift_start").alias("drift_start"),
    )
    return firsts.select(
        "scenario", "detector", "first_alarm_position",
        (F.col("first_alarm_position") - F.col("drift_start")).alias("detection_delay"),
    )


def detector_metrics(labelled: DataFrame, n_reference: int) -> DataFrame:
    """Classification metrics with the detection delay."""
    return classification_metrics(labelled, n_reference).join(detection_delay(labelled), ["scenario", "detector"])


def agreement_matrix(scored: DataFrame, n_reference: int) -> DataFrame:
    """Alarm overlap per scenario; a missing alarm counts as no alarm, rates over all stream windows."""
    overlap = scoring.alarm_overlap(F.col("driftlens_alarm"), F.col("mcddd_alarm"))
    stream = scored.filter(F.col("position") >= n_reference).withColumn("overlap", overlap)
    names = ("both_alarm", "both_no_alarm", "driftlens_only", "mcddd_only")
    counts = stream.groupBy("scenario").agg(
        *[F.count_if(F.col("overlap") == n).alias(n) for n in names], F.count("*").alias("windows")
    )
    return counts.select(
        "scenario", *names,
        safe_rate(F.col("both_alarm") + F.col("both_no_alarm"), F.col("windows")).alias("agreement_rate"),
        safe_rate(F.col("driftlens_only") + F.col("mcddd_only"), F.col("windows")).alias("disagreement_rate"),
    )


def performance(scored: DataFrame, n_reference: int) -> DataFrame:
    """Mean and median latency and throughput over the stream windows."""
    return scored.filter(F.col("position") >= n_reference).groupBy("scenario").agg(
        F.avg("processing_latency_ms").alias("mean_latency_ms"),
        F.median("processing_latency_ms").alias("median_latency_ms"),
        F.avg("throughput_posts_per_sec").alias("mean_throughput_posts_sec"),
        F.median("throughput_posts_per_sec").alias("median_throughput_posts_sec"),
    )


def window_comparison(labelled: DataFrame) -> DataFrame:
    """Every window with label, unrounded ratios, alarms and overlap class."""
    return labelled.select(
        "scenario", "position", "window_id", "window_start", "ground_truth_drift",
        "driftlens_score", F.col("threshold").alias("driftlens_threshold"),
        scoring.ratio(F.col("driftlens_score"), F.col("threshold"), None).alias("driftlens_ratio"),
        _alarm("driftlens").alias("driftlens_alarm"),
        "mcddd_score", "mcddd_threshold",
        scoring.ratio(F.col("mcddd_score"), F.col("mcddd_threshold"), None).alias("mcddd_ratio"),
        _alarm("mcddd").alias("mcddd_alarm"),
        scoring.alarm_overlap(F.col("driftlens_alarm"), F.col("mcddd_alarm")).alias("agreement"),
        F.col("processing_latency_ms").alias("latency_ms"),
        F.col("throughput_posts_per_sec").alias("throughput_posts_sec"),
    )


def side_by_side(metrics: DataFrame, agreement: DataFrame) -> DataFrame:
    """One row per scenario: every metric of both detectors, and the agreement rates."""
    names = ("precision", "recall", "f1", "false_alarm_rate", "detection_delay")
    wide = metrics.groupBy("scenario").pivot("detector", list(DETECTORS)).agg(
        *[F.max(n).alias(n) for n in names]
    )
    return wide.join(agreement.select("scenario", "agreement_rate", "disagreement_rate"), "scenario")


def _rate(flag: Column, among: Column) -> Column:
    """Share of `flag` among rows where `among` holds, 4 dp; NULL when there are none."""
    return F.round(F.try_divide(F.count_if(flag & among), F.count_if(among)), 4)


def scenario_metrics(labelled: DataFrame, n_reference: int, tolerance: int = 3) -> DataFrame:
    """Alarm rates around the change, delay and detection within tolerance, per scenario and detector."""
    rows = per_detector(labelled)
    position, alarm = F.col("position"), F.col("alarm")
    start, change = F.col("drift_start"), F.col("volume_change")
    stream = position >= n_reference
    is_drift, is_volume = start.isNotNull(), start.isNull() & change.isNotNull()
    is_quiet = ~is_drift & ~is_volume & (F.col("concept_drift") == F.lit(False))
    before, after = stream & is_drift & (position < start), is_drift & (position >= start)
    volume_before, volume_after = stream & is_volume & (position < change), is_volume & (position >= change)
    grouped = rows.groupBy("scenario", "detector").agg(
        F.count_if(stream & alarm).cast("int").alias("alarms"),
        F.count_if(stream).cast("int").alias("stream_windows"),
        _rate(alarm, stream).alias("alarm_rate"),
        F.array_sort(F.collect_list(F.when(stream & alarm, position))).alias("alarm_positions"),
        F.when(F.first(is_drift), F.count_if(before & alarm).cast("int")).alias("false_alarms_before_drift"),
        _rate(alarm, before).alias("false_alarm_rate_before_drift"),
        F.min(F.when(after & alarm, position)).alias("first_alarm_after_drift"),
        _rate(alarm, after).alias("alarm_rate_after_drift"),
        _rate(alarm, volume_before).alias("false_alarm_rate_before_volume_change"),
        _rate(alarm, volume_after).alias("false_alarm_rate_after_volume_change"),
        F.bool_or(F.when(is_volume & (position == change), alarm)).alias("alarm_at_volume_change"),
        F.when(F.first(is_quiet), _rate(alarm, stream)).alias("false_alarm_rate"),
        F.max("drift_start").alias("drift_start"), F.max("drift_end").alias("drift_end"),
    )
    delay = F.col("first_alarm_after_drift") - F.col("drift_start")
    on_time = F.coalesce(delay <= F.lit(tolerance) + F.col("drift_end") - F.col("drift_start"), F.lit(False))
    return grouped.withColumns({
        "detection_delay": delay,
        "detected_within_tolerance": F.when(F.col("drift_start").isNotNull(), on_time),
    }).drop("drift_start", "drift_end")


def _percent(rate: str) -> Column:
    return F.concat(scoring.fixed(F.col(rate) * 100, 0), F.lit("%"))


def summary_rows(metrics: DataFrame, truth: DataFrame) -> DataFrame:
    """Text cells of the scenario summary table; a scenario of `truth` without scores is a row "not run"."""
    start, end = F.col("drift_start"), F.col("drift_end")
    expected = (
        F.when(start.isNotNull(), F.concat(F.lit("drift at "), start.cast("string"), F.when(
            end != start, F.concat(F.lit("-"), end.cast("string"))).otherwise("")))
        .when(F.col("volume_change").isNotNull(),
              F.format_string("no drift (volume x%d at %d)", F.col("volume_factor"), F.col("volume_change")))
        .when(F.col("concept_drift") == F.lit(False), "no drift").otherwise("unknown (real)")
    )
    is_drift, is_volume = start.isNotNull(), start.isNull() & F.col("volume_change").isNotNull()
    first = F.coalesce(F.format_string("%d (+%d)", F.col("first_alarm_after_drift"), F.col("detection_delay")), F.lit("none"))
    first = F.when(F.col("first_alarm_after_drift").isNull(), "none").otherwise(first)
    none = F.lit("-")
    idle = truth.join(metrics.select("scenario").distinct(), "scenario", "left_anti").select(
        "scenario", none.alias("detector"), none.alias("expected"), F.lit("not run").alias("stream_alarms"),
        none.alias("false_alarms"), none.alias("first_alarm"), none.alias("alarm_rate_after"))
    return metrics.join(truth, "scenario").select(
        "scenario", "detector", expected.alias("expected"),
        F.concat_ws("/", F.col("alarms").cast("string"), F.col("stream_windows").cast("string")).alias("stream_alarms"),
        F.when(is_drift, F.format_string("%d (%s)", F.col("false_alarms_before_drift"),
                                         _percent("false_alarm_rate_before_drift")))
        .when(is_volume, _percent("false_alarm_rate_before_volume_change")).otherwise("-").alias("false_alarms"),
        F.when(is_drift, first).otherwise("-").alias("first_alarm"),
        F.when(is_drift, _percent("alarm_rate_after_drift"))
        .when(is_volume, F.concat(_percent("false_alarm_rate_after_volume_change"), F.lit(" (any alarm is false)")))
        .otherwise("-").alias("alarm_rate_after"),
    ).unionByName(idle)


def markdown(summary: DataFrame) -> DataFrame:
    """One Markdown table line per row of any summary frame."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in summary.columns])
    return summary.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def _spread(name: str) -> Column:
    """`median [min-max]`, `-` when every run is NULL."""
    value = F.col(name)
    middle = F.regexp_replace(F.median(value).cast("string"), r"\.0$", "")
    text = F.concat(middle, F.lit(" ["), F.min(value).cast("string"), F.lit("-"), F.max(value).cast("string"), F.lit("]"))
    return F.coalesce(text, F.lit("-"))


def seed_spread(runs: DataFrame) -> DataFrame:
    """Repeated runs (`scenario, seed, alarms, false_alarms_before_drift, detection_delay, ...`) per scenario."""
    is_drift = F.bool_or(F.col("false_alarms_before_drift").isNotNull())
    detected = F.concat_ws("/", F.count("first_alarm_after_drift").cast("string"), F.count("*").cast("string"))
    return runs.groupBy("scenario").agg(
        _spread("alarms").alias("stream_alarms"),
        F.when(is_drift, _spread("false_alarms_before_drift"))
        .otherwise(F.concat(_spread("alarms"), F.lit(" (all false)"))).alias("false_alarms"),
        F.when(is_drift, _spread("detection_delay")).otherwise("-").alias("first_alarm_delay"),
        F.when(is_drift, detected).otherwise("-").alias("detected_runs"),
    )


def plot_alarms(scored: DataFrame, n_reference: int) -> DataFrame:
    """Bar data: alarms per scenario and detector."""
    stream = scored.filter(F.col("position") >= n_reference)
    return stream.groupBy("scenario").agg(*[F.count_if(_alarm(d)).alias(f"{d}_alarms") for d in DETECTORS])


def plot_ratios(labelled: DataFrame, n_reference: int) -> DataFrame:
    """Line data: both ratios by position with the change markers."""
    return window_comparison(labelled).filter(F.col("position") >= n_reference).select(
        "scenario", "position", "driftlens_ratio", "mcddd_ratio"
    )


def plot_distributions(scored: DataFrame, n_reference: int) -> DataFrame:
    """Box data: quartiles of latency and throughput per scenario."""
    points = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    stream = scored.filter(F.col("position") >= n_reference)
    boxes = stream.groupBy("scenario").agg(
        F.percentile("processing_latency_ms", points).alias("latency"),
        F.percentile("throughput_posts_per_sec", points).alias("throughput"),
    )
    names = ("min", "q1", "median", "q3", "max")
    return boxes.select(
        "scenario",
        *[F.col("latency")[i].alias(f"latency_{n}") for i, n in enumerate(names)],
        *[F.col("throughput")[i].alias(f"throughput_{n}") for i, n in enumerate(names)],
    )
