"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, where all share one disk, a folder of our own if it is unset.

    Elsewhere each executor would write to its own disk and readers would miss rows, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a result that outlasts the session."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A path in the session's own part of the shared folder, which is deleted when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/passing-{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    store.deleteOnExit(target)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path; it goes when the session does.

    This cuts lineage (a lost executor costs a reread, not a recomputation) and runs costly
    Python stages once however often the table is read.
    """
    spark = df.sparkSession
    path = passing_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a superseded table through the Hadoop file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of an Arrow batch; texts may be long, and two batches a task are in memory at once.
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches limited to BATCH_ROWS rows and about BATCH_BYTES (smaller settings stay)."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            conf.set(name, most)
    return df
