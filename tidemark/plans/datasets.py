"""The given tables in the roles of the data model: raw posts, messages, posts, vectors, scores.

Every frame is derived from whole tables. `tidemark.plans.catalog.sql` holds the same frames as SQL.
"""
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import scoring as sc, timestamps as ts
from tidemark.operators import windowing as wd

DAY, HOUR = 86400, 3600
N_REFERENCE = 14

# How the five event types stand in for the scenarios.
SCENARIO_OF_TYPE = {"click": "sudden", "view": "gradual", "signup": "volume", "error": "no_drift", "purchase": "natural"}
# Decorations that exercise the cleaning rules.
PREFIX_OF_TYPE = {"view": "RT @u5: ", "click": "http://t.co/x ", "signup": "#tag ", "error": "!!! &amp; "}
THRESHOLD, SECOND_THRESHOLD = 0.052, 1.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input comes in fewer splits (small single-file tables).

    Tables with at least as many splits as cores are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _by_type(mapping: dict, default) -> Column:
    column = F.lit(default)
    for name, value in mapping.items():
        column = F.when(F.col("event_type") == name, value).otherwise(column)
    return column


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the document it posts."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    events = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % F.lit(documents.count()))
    return events.join(documents, "doc_id").withColumn("stamp", F.substring(F.col("ts").cast("string"), 1, 19))


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-like posts with missing dates, blank texts and repeated rows."""
    source, value = event_texts(spark, sf_dir), F.col("value")
    n = table(spark, sf_dir, "events").count()
    created = F.when(value < 1, F.lit(None).cast("string")).when(value < 2, "nan").otherwise(F.substring("stamp", 1, 10))
    body = F.when((value >= 2) & (value < 3), "  \t ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    rows = source.select(created.alias("created_at"), body.alias("original_text"),
                         F.col("event_id").alias("row_number"), value.alias("value"))
    again = rows.filter((value >= 98) & (value < 99)).withColumn("row_number", F.col("row_number") + F.lit(n))
    both = rows.unionByName(again)
    return both.select("created_at", "original_text", F.col("row_number").cast("string").alias("row_index"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in all accepted time formats, with bad times, texts that clean to nothing and copies."""
    source, value, kind = event_texts(spark, sf_dir), F.col("value"), F.col("event_type")
    stamp = (
        F.when(value < 1, "not-a-date").when(kind == "click", F.replace("stamp", F.lit(" "), F.lit("T")))
        .when(kind == "purchase", F.substring("stamp", 1, 10)).otherwise(F.col("stamp"))
    )
    body = F.when((value >= 1) & (value < 3), "@u1 http://t.co/abc").otherwise(
        F.concat(_by_type(PREFIX_OF_TYPE, ""), F.col("text")))
    name = F.when(value < 99.5, F.concat(F.lit("post_"), F.col("event_id").cast("string")))
    rows = source.select(name.alias("post_id"), stamp.alias("timestamp"), body.alias("text"), kind.alias("source"), value.alias("value"))
    return rows.unionByName(rows.filter((value >= 98) & (value < 99))).drop("value")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, deduplicated posts in daily windows (long form)."""
    return wd.posts_from_messages(messages(spark, sf_dir), "1 day")


def uncleaned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts before their texts are cleaned, with those that clean to nothing."""
    return wd.uncleaned_posts(messages(spark, sf_dir), "1 day")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its vector, in daily windows."""
    stored = table(spark, sf_dir, "embeddings")
    events = spread(table(spark, sf_dir, "events")).withColumn("vec_id", F.col("event_id") % F.lit(stored.count()))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.join(stored, "vec_id").select(
        F.floor(seconds / DAY).cast("long").alias("window_id"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("window_start"),
        F.concat(F.lit("post_"), F.col("event_id").cast("string")).alias("post_id"), "embedding", "label",
    )


def _score_rows(grouped: DataFrame, position: Column, seconds: int) -> DataFrame:
    n, cents, top = F.col("n"), F.col("cents"), F.col("top")
    score = F.expr("(cents * 20 + n) div (2 * n)") / 1e6        # mean value in units of 1e-6, rounded half up
    scored = (position >= N_REFERENCE) & (cents % 7 != 0)
    second = F.when(scored, sc.sig(top / (cents / n.cast("double"))))
    latency = F.round(n * F.lit(0.31) + F.lit(0.5), 2)
    rows = grouped.withColumns({
        "position": position.cast("int"), "driftlens_score": score, "mcddd_score": second, "processing_latency_ms": latency,
    })
    return rows.select(
        *[c for c in ("scenario",) if c in grouped.columns], "window_id", "position",
        ts.iso(F.timestamp_seconds(F.col("window_id") * seconds)).alias("window_start"),
        "driftlens_score", (F.col("driftlens_score") > THRESHOLD).alias("driftlens_alarm"), F.lit(THRESHOLD).alias("threshold"),
        "mcddd_score", (F.col("mcddd_score") > SECOND_THRESHOLD).alias("mcddd_alarm"),
        F.when(F.col("mcddd_score").isNotNull(), SECOND_THRESHOLD).alias("mcddd_threshold"),
        F.when(F.col("mcddd_score").isNotNull(), (1 + top % 10).cast("int")).alias("mcddd_lag"),
        n.alias("n_posts"), F.least(n, F.lit(10)).alias("n_used"), (F.col("position") < N_REFERENCE).alias("is_reference"),
        "processing_latency_ms", F.round(n / (F.col("processing_latency_ms") / 1000.0), 2).alias("throughput_posts_per_sec"),
    )


def _volumes(spark: SparkSession, sf_dir: str, seconds: int, by: list) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long").alias("window_id")
    return table(spark, sf_dir, "events").groupBy(*by, window).agg(
        F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max(cents).alias("top"))


def scores(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Score rows per window, derived from the event values."""
    order = Window.orderBy("window_id")          # one row per window
    return _score_rows(_volumes(spark, sf_dir, seconds, []), F.row_number().over(order) - 1, seconds)


def scenario_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily score rows of five scenarios (one per event type)."""
    grouped = _volumes(spark, sf_dir, DAY, [_by_type(SCENARIO_OF_TYPE, "other").alias("scenario")])
    order = Window.partitionBy("scenario").orderBy("window_id")
    return _score_rows(grouped, F.row_number().over(order) - 1, DAY)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the scenarios found in the events."""
    found = table(spark, sf_dir, "events").select(_by_type(SCENARIO_OF_TYPE, "other").alias("scenario")).distinct()
    name = F.col("scenario")
    return found.select(
        "scenario", F.when(name != "natural", name.isin("sudden", "gradual")).alias("concept_drift"),
        F.when(name.isin("sudden", "gradual"), 20).alias("drift_start"),
        F.when(name == "sudden", 20).when(name == "gradual", 24).alias("drift_end"),
        F.when(name == "volume", 20).alias("volume_change"), F.when(name == "volume", 3).alias("volume_factor"),
    )


def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows under both field vocabularies, with missing and non-numeric fields (text scores)."""
    rows = scores(spark, sf_dir)
    n, text = F.col("n_posts"), sc.float_text(F.col("driftlens_score"))
    old = F.col("window_id") % 2 == 0
    missing = F.col("throughput_posts_per_sec")
    return rows.select(
        F.when(n != 3, F.col("window_id")).alias("window_id"),
        F.when(old & (n != 7), F.col("window_start")).alias("window_start"),
        F.when(~old, F.col("window_start")).alias("timestamp"),
        F.when(n == 4, "n/a").when(n != 5, text).alias("driftlens_score"),
        F.when(n != 6, F.col("driftlens_alarm")).alias("driftlens_alarm"),
        F.when(old, F.col("threshold")).alias("threshold"), F.when(~old, F.col("threshold")).alias("driftlens_threshold"),
        "mcddd_score", "mcddd_alarm", "mcddd_threshold", "mcddd_lag",
        F.when(old, n).alias("n_posts"), F.when(~old, n).alias("post_count"), "n_used", "is_reference",
        F.lit(None).cast("string").alias("agreement"), "processing_latency_ms",
        F.when(n % 4 != 0, missing).alias("throughput_posts_per_sec"),
        F.when(old, F.round(n * 1.25, 2)).alias("cpu_pct"), F.lit(None).cast("double").alias("mem_mb"),
        F.lit(None).cast("string").alias("pipeline"),
    )
