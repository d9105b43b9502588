"""Structured Streaming jobs: file-drop ingestion and the daily rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import cleaning, scores
from ..session import staging
from ..sources.ingest import (
    OPTIONAL_HEADERS, REQUIRED_HEADERS, normalize, rejected_rows, to_responses, valid_rows,
)
from ..sources.tables import MONTH

EXPORT_SCHEMA = T.StructType(
    [T.StructField(h, T.StringType()) for h in (*REQUIRED_HEADERS, *OPTIONAL_HEADERS)]
)


def export_stream(
    spark: SparkSession, folder: str, schema: T.StructType = EXPORT_SCHEMA, sep: str = ","
) -> DataFrame:
    """Rows of export files as they are dropped into a folder."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(folder)
    )


def ingest_stream(
    exports: DataFrame, responses_path: str, rejects_path: str, checkpoint: str
) -> StreamingQuery:
    """Normalise dropped files; append responses and rejects.

    Each micro-batch is parsed and written once, and the two tables are made
    from what was written. They are written below the folder of the batch, so a
    batch that is repeated after a failure replaces its earlier output instead
    of doubling it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession) as stage:
            append(stage(normalize(batch), "rows"), batch_id)

    def append(rows: DataFrame, batch_id: int) -> None:
        responses = to_responses(valid_rows(rows)).withColumn(
            MONTH, cleaning.month_text(F.col("creation_date"))
        )
        part = f"batch_id={batch_id}"
        responses.write.mode("overwrite").partitionBy(MONTH).parquet(f"{responses_path}/{part}")
        rejected_rows(rows).write.mode("overwrite").parquet(f"{rejects_path}/{part}")

    return (
        exports.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_trend_stream(
    responses: DataFrame, *, stamp: str = "created_at", lateness: str = "2 days"
) -> DataFrame:
    """Daily counts and net score per survey over a stream of responses.

    A day is final once the watermark has passed it; state is one row per
    survey and open day.
    """
    score = F.col("nps_score")
    counts = (
        responses.withWatermark(stamp, lateness)
        .groupBy("survey_name", F.window(stamp, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("daily_responses"),
            *scores.bucket_counts(score),
            F.sum(score).alias("score_sum"),
            F.count(score).alias("scored"),
        )
    )
    n = F.col("daily_responses")
    return counts.select(
        "survey_name",
        F.col("w.start").cast("date").alias("day"),
        "daily_responses",
        F.col("promoters").alias("daily_promoters"),
        F.col("passives").alias("daily_passives"),
        F.col("detractors").alias("daily_detractors"),
        scores.mean(F.col("score_sum"), F.col("scored"), 2).alias("daily_avg_score"),
        scores.nps_or_zero(F.col("promoters"), F.col("detractors"), n).alias("daily_nps_score"),
    )


def write_daily_trend(trend: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished days to a table."""
    return (
        trend.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
