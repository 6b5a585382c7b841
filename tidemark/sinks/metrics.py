"""Metric records: line protocol, flat rows, deduplicated delivery."""
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import scoring, timestamps as ts


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))


def _number(name: str) -> Column:
    return _tag(name, scoring.float_text(F.col(name)))


def _integer(name: str, column: str | None = None) -> Column:
    return _tag(name, F.concat(F.col(column or name).cast("long").cast("string"), F.lit("i")))


def _state(alarm: str) -> Column:
    return F.when(F.col(alarm), "drift").when(~F.col(alarm), "normal")


def to_line_protocol(df: DataFrame, measurement: str = "drift_metrics") -> DataFrame:
    """`measurement,tags fields seconds`; absent optional tags and fields are left out."""
    tags = F.concat_ws(
        ",",
        _tag("pipeline", F.col("pipeline")),
        _tag("window_id", F.col("window_id").cast("string")),
        _tag("agreement", F.col("agreement")),
        _tag("driftlens_alarm_state", _state("driftlens_alarm")),
        _tag("is_reference", F.col("is_reference").cast("string")),
        _tag("mcddd_alarm_state", _state("mcddd_alarm")),
    )
    fields = F.concat_ws(
        ",",
        _number("driftlens_score"),
        _integer("driftlens_alarm"),
        _integer("agreement_code"),
        _number("processing_latency_ms"),
        _number("throughput_posts_per_sec"),
        _number("driftlens_threshold"),
        _number("driftlens_ratio"),
        _number("mcddd_score"),
        _number("mcddd_threshold"),
        _integer("mcddd_alarm"),
        _number("mcddd_ratio"),
        _integer("mcddd_lag"),
        _number("cpu_pct"),
        _number("mem_mb"),
        _integer("post_count"),
        _integer("n_posts", "post_count"),
        _integer("n_used"),
    )
    seconds = F.unix_seconds(ts.normalise_ts(F.col("window_start"))).cast("string")
    line = F.concat(F.lit(measurement + ","), tags, F.lit(" "), fields, F.lit(" "), seconds)
    return df.select("window_id", line.alias("line"))


def _rounded(name: str, digits: int) -> Column:
    return F.coalesce(scoring.float_text(F.round(F.col(name), digits)), F.lit("")).alias(name)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("int").cast("string"), F.lit("")).alias(name)


def to_flat(df: DataFrame) -> DataFrame:
    """Nineteen text/number columns for a CSV log; NULL becomes empty text."""
    return df.select(
        F.concat(ts.iso(ts.normalise_ts(F.col("window_start"))), F.lit("+00:00")).alias("timestamp"),
        F.col("window_id").cast("string").alias("window_id"),
        _rounded("driftlens_score", 6), _rounded("driftlens_threshold", 6), _flag("driftlens_alarm"),
        _rounded("driftlens_ratio", 4),
        _rounded("mcddd_score", 6), _rounded("mcddd_threshold", 6), _flag("mcddd_alarm"),
        _rounded("mcddd_ratio", 4),
        "agreement",
        _rounded("processing_latency_ms", 2), _rounded("throughput_posts_per_sec", 2),
        _rounded("cpu_pct", 2), _rounded("mem_mb", 2),
        F.coalesce("post_count", F.lit(0)).alias("n_posts"), F.coalesce("n_used", F.lit(0)).alias("n_used"),
        F.coalesce("is_reference", F.lit(False)).cast("int").alias("is_reference"),
        "pipeline",
    )


def undelivered(records: DataFrame, delivered_ids: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One record per window id that was not delivered before: the first by `order`, else by the record's content."""
    columns = [F.col(c) for c in records.columns]
    first = F.min(F.struct(*(order or []), F.struct(*columns).alias("record")))
    fresh = records.groupBy("window_id").agg(first.alias("first")).select("first.record.*")
    return fresh.join(delivered_ids.select("window_id").distinct(), "window_id", "left_anti")


def deliver(records: DataFrame, sink_path: str, batch_id: int = 0) -> None:
    """Write flat records of windows that no other batch delivered; a retried batch rewrites itself."""
    spark = records.sparkSession
    root = sink_path.rstrip("/")
    schema = "window_id string, batch_id long"
    try:
        earlier = spark.read.option("header", True).csv(root).select("window_id", "batch_id")
    except Exception as missing:  # first delivery: the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        earlier = spark.createDataFrame([], schema)
    done = earlier.filter(F.col("batch_id").cast("long") != batch_id)
    flat = to_flat(records)
    undelivered(flat, done).write.mode("overwrite").option("header", True).csv(f"{root}/batch_id={batch_id}")
