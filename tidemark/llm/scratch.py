"""Intermediate tables in the shared folder, removed as soon as nothing reads them any more."""
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import table_folder


class Scratch:
    """Tables of one operator run. `keep` writes a frame once and reads it back, so lineage ends there and a lost
    executor costs no recomputation beyond it; `drop` removes a table whose successors are written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{table_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = f"{self.folder}/{name}"
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        # Shuffle files go when the driver's garbage collector meets their plans; ask it now, not at the next half hour.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
