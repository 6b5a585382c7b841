"""Score files and scenario ground truth."""
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark import schemas


def read_scores(spark: SparkSession, path: str, corrupt_column: str | None = None) -> DataFrame:
    """Score rows (superset schema); blank lines are skipped.

    Lines that are not JSON are left out here. With `corrupt_column` they stay, as rows with only that column, so that
    `delivery_summary` counts them among the errors.
    """
    name = corrupt_column or "_corrupt_line"
    schema = StructType([*schemas.SCORE_INPUT.fields, StructField(name, StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": name}
    rows = lines.select(F.from_json("value", schema, options).alias("row")).select("row.*")
    return rows if corrupt_column else rows.filter(F.col(name).isNull()).drop(name)


def flatten_ground_truth(df: DataFrame) -> DataFrame:
    truth = "ground_truth."
    return df.select(
        "scenario",
        F.col(truth + "concept_drift").alias("concept_drift"),
        F.col(truth + "drift_start.position").alias("drift_start"),
        F.col(truth + "drift_end.position").alias("drift_end"),
        F.col(truth + "volume_change.position").alias("volume_change"),
        F.col(truth + "volume_change.factor").alias("volume_factor"),
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Flat ground truth per scenario from nested scenario files."""
    return flatten_ground_truth(spark.read.schema(schemas.GROUND_TRUTH).json(path, multiLine=True))
