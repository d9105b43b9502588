import datetime as dt

from pyspark.sql import functions as F

from voxmetric.operators import nps
from voxmetric.streaming import jobs

HEAD = ",".join(f.name for f in jobs.EXPORT_SCHEMA.fields)


def row(survey, score, day):
    return f"{survey},{score},{day}" + "," * (len(jobs.EXPORT_SCHEMA.fields) - 3)


def test_file_drop(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    out, bad, ckpt = (str(tmp_path / n) for n in ("out", "bad", "ckpt"))

    def run():
        jobs.ingest_stream(jobs.export_stream(spark, str(drop)), out, bad, ckpt).awaitTermination(120)

    (drop / "a.csv").write_text("\n".join([HEAD, row("Q", 9, "01/02/2024"), row("Q", "x", "01/02/2024")]) + "\n")
    run()
    (drop / "b.csv").write_text("\n".join([HEAD, row("Q", 3, "2024-03-01")]) + "\n")
    run()
    run()
    got = sorted((r.nps_score, r.creation_date) for r in spark.read.parquet(out).collect())
    assert got == [(3, dt.date(2024, 3, 1)), (9, dt.date(2024, 2, 1))]
    assert [r.error for r in spark.read.parquet(bad).collect()] == ["Invalid NPS: x"]


def test_daily_trend_matches_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    rows = spark.range(500).select(
        F.concat(F.lit("S"), F.col("id") % 2).alias("survey_name"),
        (F.col("id") % 11).cast("int").alias("nps_score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("created_at"),
    )
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    jobs.write_daily_trend(jobs.daily_trend_stream(stream), out, ckpt).awaitTermination(120)
    batch = nps.daily_trend(rows.withColumn("creation_date", F.col("created_at").cast("date")))
    closed = rows.agg(F.date_sub(F.max("created_at").cast("date"), 2)).first()[0]
    want = {tuple(r) for r in batch.filter(F.col("creation_date") < closed).collect()}
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got and want <= got
    assert got <= {tuple(r) for r in batch.collect()}
