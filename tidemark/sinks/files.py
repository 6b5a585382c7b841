"""File sinks: idempotent per micro-batch, no single-task writes."""
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ingest import publish_frame
from tidemark.operators.windowing import to_output


def publish(messages: DataFrame, path: str, max_records: int | None = None) -> None:
    """Chronological (key, value) records as compressed JSON, split into day folders."""
    records = publish_frame(messages, max_records)
    day = F.substring(F.get_json_object("value", "$.timestamp"), 1, 10)
    records.withColumn("day", day).write.mode("overwrite").partitionBy("day").option("compression", "gzip").json(path)


def write_windows_batch(windows: DataFrame, batch_id: int, path: str) -> None:
    """One folder per micro-batch, overwritten on retry; rows are range-ordered by window id, files are compressed."""
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    to_output(windows).orderBy("window_id").write.mode("overwrite").option("compression", "gzip").json(target)


def write_scores(scores: DataFrame, path: str, batch_id: int = 0) -> None:
    scores.write.mode("overwrite").json(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_comparison(compared: DataFrame, summary: DataFrame, path: str) -> None:
    compared.write.mode("overwrite").json(f"{path.rstrip('/')}/comparison")
    summary.write.mode("overwrite").json(f"{path.rstrip('/')}/comparison_summary")


def write_report(document: DataFrame, path: str) -> None:
    """Nested explanations in priority order, rewritten as a whole."""
    document.orderBy("class_rank", "window_id").write.mode("overwrite").json(f"{path.rstrip('/')}/report")


def write_scenarios(windows: DataFrame, composition: DataFrame, index: DataFrame, truth: DataFrame, path: str) -> None:
    """Per scenario its windows and its manifest in folders of their own, and one file folder with index and ground truth.

    `truth` has the columns of the nested ground truth beside `scenario`.
    """
    root = path.rstrip("/")
    windows.write.mode("overwrite").partitionBy("scenario").json(f"{root}/windows")
    composition.write.mode("overwrite").partitionBy("scenario").json(f"{root}/manifest")
    nested = F.struct(*(c for c in truth.columns if c != "scenario")).alias("ground_truth")
    totals = index.select("scenario", F.col("n_windows").cast("int").alias("n_windows"), F.col("n_posts").cast("long").alias("n_posts"))
    truth.select("scenario", nested).join(totals, "scenario", "left").write.mode("overwrite").json(f"{root}/ground_truth")


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header, quotes doubled, outer whitespace kept; NULL is empty."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                   compression=compression)


def to_memory(df: DataFrame, name: str, output_mode: str = "append"):
    """Start a stream into an in-memory table (tests and notebooks)."""
    return df.writeStream.format("memory").queryName(name).outputMode(output_mode).start()
