"""Session settings, lineage cuts and the size check behind every broadcast."""
import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

# Largest frame that is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
TEXTS = "zstd"      # compression of tables of whole texts
_roots: set[str] = set()
_owned: ContextVar[list | None] = ContextVar("tables of the running block", default=None)


def build_session(app: str = "tidemark", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on, the package sent to its workers; cluster values already set are kept."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):       # the driver is the only executor then
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it from anywhere."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a scratch folder in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def _remove(jvm, configuration, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


def table_folder(spark: SparkSession) -> str:
    """Folder of all intermediate tables of a session, named after the application and removed when the driver ends."""
    root = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    return root


def cut_lineage(df: DataFrame, by: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """Materialise rows once as a table in the shared folder, so later passes see the very same rows.

    Unlike `checkpoint()` this computes the plan once, and readers get column pruning and real sizes.
    The tables live briefly, so no dictionaries are built. With `by` the table has a folder for each value of these columns;
    `compression` is TEXTS for tables of whole texts, which take most of the disk.
    """
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").option("compression", compression).partitionBy(*(by or [])).parquet(path)
    if _owned.get() is not None:
        _owned.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Remove the tables that `cut_lineage` wrote inside the block; results must be written before it ends.

    For long-running streams, whose micro-batches would otherwise fill the shared folder.
    """
    token = _owned.set([])
    try:
        yield
    finally:
        for path in _owned.get():
            _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
        _owned.reset(token)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a frame of aggregates (per window, per key): few rows, cheap last stage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _row_bytes(schema: StructType) -> Column:
    """Size of a row, about: variable parts by their length, everything else as eight bytes."""
    total = F.lit(0).cast("long")
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = F.octet_length(column)
        elif isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, NumericType):
            size = 8 * F.size(column)
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size = F.octet_length(F.to_json(column))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0)).cast("long")
    return total


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpoint a per-window or per-key frame and mark it for broadcast only if it is small, in rows and in bytes.

    Beyond either bound the frame is returned unmarked and Spark joins it by shuffle.
    """
    kept = settle(df)
    found = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(kept.schema)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(kept) if found["n"] <= max_rows and found["bytes"] <= max_bytes else kept
