"""Topic source and sink options (the connector itself is a Spark package of the cluster)."""
from pyspark.sql import DataFrame, SparkSession


def read_options(servers: str, topic: str, starting_offsets: str = "earliest",
                 group_prefix: str = "tidemark", max_offsets_per_trigger: int = 0) -> dict[str, str]:
    """Reader options; a rate cap of 0 means unlimited."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
        "groupIdPrefix": group_prefix,
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, **settings) -> DataFrame:
    return spark.readStream.format("kafka").options(**read_options(**settings)).load()


def write_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Publish a (key, value) frame."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
