"""Session defaults and lineage cutting."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale: runtime re-planning sizes shuffle
# partitions and splits skewed joins, so no per-query tuning is needed.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column expression costs more
    # than running a small query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "voxmetric",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the library defaults; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A local master gets a folder of its own when the setting is absent; a
    cluster must name one, because a machine-local folder would be lost with
    its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the staging folder; it goes when the driver's JVM ends."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a frame to the shared staging folder and reads it back.

    Used where several outputs need the same expensive intermediate: the
    written table survives the loss of executors, which a cache does not. It is
    deleted when the block ends.
    """
    root = scratch(spark, "stage")

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    try:
        yield stage
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
