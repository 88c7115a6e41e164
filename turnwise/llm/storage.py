"""Shared folders for tables and files that later stages read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share.

    The session names it in ``spark.checkpoint.dir``.  Only a local session (tests) may go
    without: there the driver's disk is everybody's disk.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and columns can be pruned."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def packed(*parts: bytes) -> bytes:
    """Byte strings behind their number and lengths, compressed together."""
    sizes = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.compress(b"".join([sizes, *parts]), 3)


def unpacked(payload: bytes) -> list[bytes]:
    """The byte strings of ``packed``."""
    raw = zstandard.decompress(payload)
    n = int.from_bytes(raw[:8], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u8", n, 8)) + 8 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends], ends)]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones without copying, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
