"""Session settings the jobs are designed for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "turnwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win when already present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may go without one (tests, the bench): its driver's disk is the only disk.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (with ``options`` of the writer) and read it back.

    Used where a frame is read by several jobs or fits: its lineage is not replayed, a lost executor
    loses nothing, and a reader of few columns reads few columns.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(frame: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once nothing reads it any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
