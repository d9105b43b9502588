"""Parquet tables: pruned scans, appends, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cleaning
from ..operators.quality import upsert
from ..session import staging

MONTH = "creation_month"
BUCKET = "key_bucket"


def scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    *predicates: Column,
) -> DataFrame:
    """Table scan with chosen columns and row predicates, both pushed down."""
    rows = spark.read.parquet(path)
    for p in predicates:
        rows = rows.filter(p)
    return rows.select(*columns) if columns else rows


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a table.

    Rebalancing by the partition columns gives few, evenly sized files even
    when one partition receives most of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_responses(df: DataFrame, path: str) -> None:
    """Append responses partitioned by month, so date ranges prune files."""
    append(
        df.withColumn(MONTH, cleaning.month_text(F.col("creation_date"))), path, [MONTH]
    )


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """New table partitioned by hash of its key, ready for ``upsert_table``."""
    rows = df.withColumn(BUCKET, key_bucket(key, buckets))
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def upsert_table(
    incoming: DataFrame,
    path: str,
    key: str,
    buckets: int,
    parents: DataFrame | None = None,
    parent_key: str = "id",
    touch: str | None = "updated_at",
    newest: Sequence[str] = (),
) -> None:
    """Insert or replace rows by key in a table written by ``write_keyed``.

    Only the key buckets that receive rows are read and rewritten. The result
    is staged first: a table is never overwritten while it is being read. What
    was staged is deleted at the end. Of incoming rows with one key the newest
    by ``newest`` stays (see ``upsert``). ``touch`` names a column set to the
    write time of replaced and new rows.
    """
    spark = incoming.sparkSession
    if touch and touch in spark.read.parquet(path).columns:
        incoming = incoming.withColumn(touch, F.current_timestamp())
    incoming = incoming.withColumn(BUCKET, key_bucket(key, buckets))
    touched = incoming.select(BUCKET).distinct()
    # At most ``buckets`` rows, so the semi join prunes partitions of the scan.
    current = spark.read.parquet(path).join(F.broadcast(touched), BUCKET, "left_semi")
    with staging(spark) as stage:
        merged = stage(upsert(current, incoming, key, parents, parent_key, newest), "merged")
        overwrite_partitions(merged, path, [BUCKET])


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions present in ``df``; others stay. Makes reruns idempotent."""
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
