"""Progress of running queries as data."""
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = ("query string, batch_id bigint, input_rows bigint, operator string, state_rows bigint, "
          "dropped_by_watermark bigint, duplicates_dropped bigint")


def _rows(progress: dict) -> list[tuple]:
    base = (progress.get("name") or progress["id"], progress["batchId"], progress["numInputRows"])
    operators = progress.get("stateOperators") or []
    if not operators:
        return [(*base, None, None, None, None)]
    return [(*base, o.get("operatorName"), o.get("numRowsTotal"), o.get("numRowsDroppedByWatermark"),
             (o.get("customMetrics") or {}).get("numDroppedDuplicateRows")) for o in operators]


def progress_table(query) -> DataFrame:
    """One row per micro-batch and state operator, from the query's recent progress.

    Spark keeps the last updates only (spark.sql.streaming.numRecentProgressUpdates); `ProgressCollector` keeps all.
    """
    entries = [json.loads(p.json) if hasattr(p, "json") and not isinstance(p, dict) else p for p in query.recentProgress]
    return SparkSession.active().createDataFrame([r for p in entries for r in _rows(p)], SCHEMA)


def late_rows(progress: DataFrame) -> DataFrame:
    """Rows dropped below the watermark, per query."""
    return progress.groupBy("query").sum("dropped_by_watermark").withColumnRenamed("sum(dropped_by_watermark)", "late_rows")


class ProgressCollector(StreamingQueryListener):
    """Appends every progress update of all queries of a session to a table, so none is lost on a long run.

    One small file for each update (or for each `flush_every` rows, and when a query ends), written through the file
    system and without a Spark job, so the listener keeps up with short micro-batches. A file appears under its name
    once it is whole; rows that could not be written wait for the next flush.
    """

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 1):
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self.waiting: list[tuple] = []
        self.ended: set[str] = set()
        self.changed = threading.Condition(threading.RLock())

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.path)

    def drain(self, query, timeout: float = 60) -> list[int]:
        """Wait until all updates of a query that has ended are in the table; returns the batches that are missing."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(query.runId) in self.ended, timeout):
                raise TimeoutError(f"no end of query {query.name or query.id} seen in {timeout} s")
            self.flush()
        name = query.name or str(query.id)
        seen = {r["batch_id"] for r in self.table().filter(F.col("query") == name).select("batch_id").distinct().collect()}
        return sorted(set(range(min(seen), max(seen) + 1)) - seen) if seen else []

    def flush(self) -> None:
        with self.changed:
            if not self.waiting:
                return
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            lines = "".join(json.dumps(dict(zip(names, row))) + "\n" for row in self.waiting).encode()
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            name = uuid.uuid4().hex
            hidden, final = path(f"{self.path}/_{name}"), path(f"{self.path}/{name}.json")
            files = final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            out = files.create(hidden)
            try:
                out.write(lines)
            finally:
                out.close()
            if not files.rename(hidden, final):
                raise OSError(f"could not write {final}")
            self.waiting.clear()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        with self.changed:
            self.waiting += _rows(json.loads(event.progress.json))
            if len(self.waiting) >= self.flush_every:
                self.flush()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.changed:
            self.flush()
            self.ended.add(str(event.runId))
            self.changed.notify_all()
