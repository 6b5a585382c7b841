"""Two detectors side by side: normalised score rows, agreement, rollups, priority windows."""
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import scoring, timestamps as ts
from tidemark.operators.ordered import with_earlier


# Fixed value: pipeline tag of records that carry none.
DEFAULT_PIPELINE = "cdd-stream"


def normalise_scores(df: DataFrame) -> DataFrame:
    """Resolve the alternative field names and defaults of score rows once."""
    latency = F.coalesce("processing_latency_ms", F.lit(0.0))
    posts = F.coalesce("n_posts", "post_count", F.lit(0)).cast("long")
    given = F.coalesce("throughput_posts_per_sec", F.lit(0.0))
    threshold = F.coalesce("threshold", "driftlens_threshold")
    agreement = F.coalesce(
        F.when(F.col("agreement") != "", F.col("agreement")),
        scoring.classify_agreement(F.col("is_reference"), F.col("driftlens_alarm"), F.col("mcddd_alarm")),
    )
    return df.select(
        "window_id",
        F.coalesce(F.when(F.col("window_start") != "", F.col("window_start")), F.col("timestamp")).alias("window_start"),
        "driftlens_score", threshold.alias("driftlens_threshold"),
        scoring.ratio(F.col("driftlens_score"), F.when(threshold > 0, threshold)).alias("driftlens_ratio"),
        "driftlens_alarm",
        "mcddd_score", "mcddd_threshold",
        scoring.ratio(F.col("mcddd_score"), F.when(F.col("mcddd_threshold") > 0, F.col("mcddd_threshold")))
        .alias("mcddd_ratio"),
        "mcddd_alarm", "mcddd_lag",
        agreement.alias("agreement"), scoring.agreement_code(agreement).alias("agreement_code"),
        posts.alias("post_count"), F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"),
        F.coalesce("is_reference", F.lit(False)).alias("is_reference"),
        latency.alias("processing_latency_ms"),
        F.when((given <= 0) & (latency > 0) & (posts > 0), F.round(scoring.throughput(posts, latency), 2))
        .otherwise(given).alias("throughput_posts_per_sec"),
        "cpu_pct", "mem_mb", F.coalesce("pipeline", F.lit(DEFAULT_PIPELINE)).alias("pipeline"),
    )


def with_reject_reason(df: DataFrame) -> DataFrame:
    """`reject_reason` is NULL for usable rows, else the first missing requirement.

    Scores and ids may be text in `df`; `driftlens_score` must read as a number.
    """
    score = F.col("driftlens_score").cast("string")
    start = F.coalesce(F.when(F.col("window_start") != "", F.col("window_start")),
                       F.when(F.col("timestamp") != "", F.col("timestamp")))
    reason = (
        F.when(F.col("window_id").isNull(), "missing window_id")
        .when(score.isNull(), "missing driftlens_score")
        .when(score.try_cast("double").isNull(), "non-numeric driftlens_score")
        .when(F.col("driftlens_alarm").isNull(), "missing driftlens_alarm")
        .when(start.isNull(), "missing timestamp")
    )
    return df.withColumn("reject_reason", reason)


def validate_scores(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with reason)."""
    marked = with_reject_reason(df)
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.filter(F.col("reject_reason").isNotNull())


def stream_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_reference"))


def compare(df: DataFrame) -> DataFrame:
    """Score rows -> comparison rows with ratios and agreement class."""
    first = F.coalesce("driftlens_alarm", F.lit(False))
    reference = F.coalesce("is_reference", F.lit(False))
    return df.select(
        "window_id", "window_start", "n_posts", reference.alias("is_reference"),
        "driftlens_score", F.col("threshold").alias("driftlens_threshold"),
        scoring.ratio(F.col("driftlens_score"), F.col("threshold")).alias("driftlens_ratio"),
        first.alias("driftlens_alarm"),
        "mcddd_score", "mcddd_threshold",
        scoring.ratio(F.col("mcddd_score"), F.col("mcddd_threshold")).alias("mcddd_ratio"),
        "mcddd_alarm", "mcddd_lag",
        scoring.classify_agreement(reference, first, F.col("mcddd_alarm")).alias("agreement"),
    )


def score_both(first_scores: DataFrame, second_scores: DataFrame) -> DataFrame:
    """One row per window; windows the second detector did not score keep NULL fields."""
    return first_scores.join(second_scores, "window_id", "left")


def agreement_counts(compared: DataFrame) -> DataFrame:
    return stream_only(compared).groupBy("agreement").agg(F.count("*").alias("windows"))


def _count_class(name: str):
    return F.count_if(F.col("agreement") == name)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: alarms, agreement rate over scored windows and the overlap text `both/second alarms`."""
    agreed = _count_class("both") + _count_class("neither")
    scored = F.count_if(F.col("mcddd_alarm").isNotNull())
    return stream_only(compared).agg(
        F.count("*").alias("stream_windows"),
        F.count_if("driftlens_alarm").alias("driftlens_alarms"),
        F.count_if(F.coalesce("mcddd_alarm", F.lit(False))).alias("mcddd_alarms"),
        *[_count_class(c).alias(c) for c in ("both", "driftlens_only", "mcddd_only", "neither", "mcddd_missing")],
        F.round(F.try_divide(agreed, scored), 4).alias("agreement_rate"),
        F.concat_ws("/", _count_class("both").cast("string"),
                    (_count_class("both") + _count_class("mcddd_only")).cast("string"))
        .alias("mcddd_alarms_also_flagged_by_driftlens"),
    )


def by_month(compared: DataFrame) -> DataFrame:
    month = F.substring(F.coalesce("window_start", F.lit("")), 1, 7).alias("month")
    return stream_only(compared).groupBy(month).agg(
        F.count("*").alias("windows"),
        F.count_if("driftlens_alarm").alias("driftlens_alarms"),
        F.count_if(F.coalesce("mcddd_alarm", F.lit(False))).alias("mcddd_alarms"),
        F.median("driftlens_score").alias("median_driftlens_score"),
    )


def with_previous(df: DataFrame) -> DataFrame:
    """The preceding record of every record in stream order; the first one precedes itself.

    Works on one-row-per-window frames in range slices; a slice's last record goes on to the next slice.
    """
    before = F.get("earlier", F.lit(0))
    return with_earlier(df, ["window_id"], ["window_id", "window_start", "n_posts"], 1).withColumns({
        "before_window_id": F.coalesce(before["window_id"], F.col("window_id")),
        "before_window_start": F.coalesce(before["window_start"], F.col("window_start")),
        "before_posts": F.coalesce(before["n_posts"], F.col("n_posts")),
    }).drop("earlier")


# How many windows of each class are explained (None = all) and why.
PRIORITY_CLASSES = (
    ("mcddd_only", None, "mcddd_only_disagreement"),
    ("both", 4, "consensus_major_drift"),
    ("driftlens_only", 3, "driftlens_only_gradual_drift"),
    ("neither", 1, "consensus_normal_benchmark"),
)


def select_important(compared: DataFrame) -> DataFrame:
    """Stream windows worth explaining, with a reason and a rank inside their class."""
    first, second = F.coalesce("driftlens_ratio", F.lit(0.0)), F.coalesce("mcddd_ratio", F.lit(0.0))
    agreement = F.col("agreement")
    priority = (
        F.when(agreement == "mcddd_only", second).when(agreement == "both", F.round(first + second, 4))
        .when(agreement == "driftlens_only", first).otherwise(F.lit(0.0))
    )
    reason, limit = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, n, why in PRIORITY_CLASSES:
        reason = F.when(agreement == name, why).otherwise(reason)
        limit = F.when(agreement == name, F.lit(n if n is not None else 2**31 - 1)).otherwise(limit)
    ranked = Window.partitionBy("agreement").orderBy(F.desc("priority"), "window_id")
    return (
        stream_only(compared).withColumns({"priority": priority, "reason": reason, "class_limit": limit})
        .filter(F.col("reason").isNotNull())
        .withColumn("class_rank", F.row_number().over(ranked))
        .filter(F.col("class_rank") <= F.col("class_limit"))
        .drop("class_limit")
    )


def delivery_summary(records: DataFrame, delivered_ids: DataFrame) -> DataFrame:
    """One row: read, newly delivered, skipped as duplicates, rejected, and classes of the new ones.

    Usable rows of one window are folded before the final count, so copies of a window stay cheap.
    """
    done = delivered_ids.select(F.col("window_id")).distinct().withColumn("done", F.lit(True))
    marked = with_reject_reason(records).withColumn("usable", F.col("reject_reason").isNull())
    agreement = F.coalesce(
        F.when(F.col("agreement") != "", F.col("agreement")),
        scoring.classify_agreement(F.col("is_reference"), F.col("driftlens_alarm"), F.col("mcddd_alarm")),
    )
    per_window = (
        marked.withColumn("agreement", agreement).groupBy("window_id", "usable")
        .agg(F.count("*").alias("copies"), F.min("agreement").alias("agreement"))
        .join(done, "window_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    )
    fresh = F.col("usable") & ~F.col("done")
    repeated = F.when(F.col("done"), F.col("copies")).when(F.col("usable"), F.col("copies") - 1).otherwise(F.lit(0))
    return per_window.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.count_if(fresh).alias("new_ingested"),
        F.coalesce(F.sum(repeated), F.lit(0)).alias("skipped_duplicate"),
        F.coalesce(F.sum(F.when(~F.col("usable") & ~F.col("done"), F.col("copies"))), F.lit(0)).alias("errors"),
        *[F.count_if(fresh & (F.col("agreement") == c)).alias(f"{c}_windows")
          for c in ("both", "driftlens_only", "mcddd_only", "neither", "reference")],
    )


def panel_scores(compared: DataFrame) -> DataFrame:
    """Dashboard: score against threshold over time, both detectors."""
    return compared.select(
        "window_id", "window_start", "driftlens_score", "driftlens_threshold", "mcddd_score", "mcddd_threshold"
    )


def panel_agreement(compared: DataFrame) -> DataFrame:
    """Dashboard: agreement code over time."""
    return compared.select(
        "window_id", "window_start", "agreement", scoring.agreement_code(F.col("agreement")).alias("agreement_code")
    )


def panel_volume(scores: DataFrame) -> DataFrame:
    """Dashboard: posts seen and posts used per window, latency and throughput."""
    return scores.select(
        "window_id", "window_start", "n_posts", "n_used", "processing_latency_ms", "throughput_posts_per_sec"
    )


def disagreement_table(scores: DataFrame) -> DataFrame:
    """All windows with scores, thresholds, ratios, alarms, class and volumes (14 columns)."""
    compared = compare(scores).select(
        "window_id", "window_start", "is_reference",
        "driftlens_score", "driftlens_threshold", "driftlens_ratio", "driftlens_alarm",
        "mcddd_score", "mcddd_threshold", "mcddd_ratio", "mcddd_alarm", "agreement", "n_posts",
    )
    used = scores.select("window_id", F.coalesce("n_used", F.lit(0)).alias("n_used"))
    return compared.join(used, "window_id")
