"""Session settings the operators are designed around, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster session should carry. AQE sizes and coalesces shuffles and
# splits skewed join partitions; forcing the split covers joins whose output is
# grouped on the same key, where Spark would otherwise keep the hot partition whole.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}

# Arrow batches sent to Python are bounded by bytes, so rows holding long
# vectors or texts do not pile up in one batch.
ARROW_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}


def session(app: str = "plenum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword arguments override them
    (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in (SETTINGS | ARROW_BATCH_BYTES | overrides).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_skewed_joins(spark: SparkSession) -> None:
    """Turn on splitting of hot join partitions in a session made elsewhere."""
    for key in ("skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{key}", "true")


# Bytes of a shuffle that one task reads, and of input files for each partition of a shuffle.
# Rows compress well in a shuffle: 60 MB of them took 2.2 GB in the joins and groupings of a task.
TASK_BYTES, FILE_BYTES = 4 << 20, 1 << 20
# Bytes of files that one task scans: rows are grouped as they are scanned, and 19 MB of stored
# parts of scores took 540 MB there. Spark's own bound is 128 MB.
SCAN_BYTES = 8 << 20


def partitions_by_input(spark: SparkSession, *paths: str) -> None:
    """As many shuffle partitions as the files under ``paths`` ask for, so that the memory of a
    task does not grow with them, but no fewer than are set. AQE merges partitions up to
    ``TASK_BYTES``; a task scans ``SCAN_BYTES`` of files, or one row group."""
    total = 0
    for path in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    key, wanted = "spark.sql.shuffle.partitions", -(-total // FILE_BYTES)
    if wanted > int(spark.conf.get(key)):
        spark.conf.set(key, str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SCAN_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset the context's
    checkpoint folder serves. If there is none either, a local run gets a temporary one;
    on a cluster, whose executors would not share it, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="plenum-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The written table cuts
    the lineage, survives lost executors, and gives later joins true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
