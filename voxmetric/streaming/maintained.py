"""Daily score sums kept up to date under late, corrected and deleted responses.

The state is a keyed table of responses (see ``sources.snapshots``) and additive
sums per (survey, day). A batch of changes is reduced to the newest version of
each id and compared with the state, of which only the touched key buckets are
read. What a change replaces is subtracted and what it brings is added, so a
batch writes signed sums of the days that it touches, whatever the size of the
table.

One manifest publishes the rows, the signed sums and the number of the batch
together: after a failure either all of a batch counts or nothing, and a batch
that is repeated is skipped. Signed sums are merged once there are more than
``MOST_SUMS`` folders of them.

Changes are (id, version, deleted, survey_name, created_at, nps_score). Order does
not matter: an older version of an id that arrives late changes nothing, and of
changes with equal versions the one stored first stays. Null ids and null versions
are no changes. A deleted id may come back with a higher version.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scores
from ..operators.quality import one_per_key
from ..session import staging
from ..sources.snapshots import KeyedTable

CHANGE = "id bigint, version bigint, deleted boolean, survey_name string, created_at timestamp, nps_score int"
KEYS = ("survey_name", "day")
SUMS = ("responses", "promoters", "passives", "detractors", "score_sum", "scored")
MOST_SUMS = 16


class MaintainedTrend:
    """Sums per survey and day that follow a stream of changes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.table = spark, KeyedTable(spark, path)
        if not self.table.files.versions():
            empty = spark.createDataFrame([], CHANGE)
            self.table = KeyedTable.create(empty, path, "id", buckets, {"batch": -1, "sums": []})

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it counts already."""
        manifest = self.table.files.manifest()
        if batch <= manifest["batch"]:
            return False
        names = [c.split()[0] for c in CHANGE.split(", ")]
        given = changes.filter("id is not null and version is not null")
        given = given.select(*names).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        with staging(self.spark) as stage:
            newest = stage(one_per_key(given, "id", ["version"]), "newest")
            place = self.table.bucket_of(manifest)
            # At most as many rows as there are buckets.
            touched = [r.b for r in newest.select(place.alias("b")).distinct().collect()]
            old = self.table._rows(manifest, touched).select("id", F.struct(*names).alias("old"))
            both = newest.select("id", F.struct(*names).alias("new")).join(old, "id", "left")
            both = stage(both.filter("old is null or new.version > old.version"), "both")
            sums = self._write(_signed(both))
            self.table.upsert(both.select("new.*"), touch=None, notes=self._notes(manifest, batch, sums))
        return True

    def _write(self, sums: DataFrame) -> str:
        folder = f"sums/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.table.path}/{folder}")
        return folder

    def _notes(self, manifest: dict, batch: int, sums: str) -> dict:
        folders = [*manifest["sums"], sums]
        if len(folders) > MOST_SUMS:
            folders = [self._write(self._summed(folders))]
        return {"batch": batch, "sums": folders}

    def _summed(self, folders: list[str]) -> DataFrame:
        """One row per survey and day that has responses."""
        rows = self.spark.read.parquet(*[f"{self.table.path}/{f}" for f in folders])
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.filter(functools.reduce(Column.__or__, [F.col(c) != 0 for c in SUMS]))

    def trend(self) -> DataFrame:
        """Counts, mean and net score per survey and day, of all batches so far."""
        folders = self.table.files.manifest()["sums"]
        if not folders:
            raise ValueError("no batch has been committed")
        n = F.col("responses")
        return self._summed(folders).select(
            *KEYS,
            n.alias("daily_responses"),
            *[F.col(c).alias(f"daily_{c}") for c in ("promoters", "passives", "detractors")],
            scores.mean(F.col("score_sum"), F.col("scored"), 2).alias("daily_avg_score"),
            scores.nps_or_zero(F.col("promoters"), F.col("detractors"), n).alias("daily_nps_score"),
        )

    def vacuum(self) -> None:
        """Delete folders that the newest version does not use."""
        self.table.vacuum()
        used = self.table.files.manifest()["sums"]
        for name in self.table.files.folders("sums"):
            if f"sums/{name}" not in used:
                self.table.files.delete(f"sums/{name}")


def _signed(both: DataFrame) -> DataFrame:
    """Sums per survey and day of what changes bring, less what they replace."""
    sides = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("r"))
    )
    rows = both.select(F.inline(sides)).filter("r is not null and not r.deleted")
    score, sign = F.col("r.nps_score"), F.col("sign")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, sign)), F.lit(0)).cast("bigint")

    return rows.groupBy(F.col("r.survey_name").alias("survey_name"), F.to_date("r.created_at").alias("day")).agg(
        total(F.lit(True)).alias("responses"),
        total(scores.is_promoter(score)).alias("promoters"),
        total(scores.is_passive(score)).alias("passives"),
        total(scores.is_detractor(score)).alias("detractors"),
        F.coalesce(F.sum(score * sign), F.lit(0)).cast("bigint").alias("score_sum"),
        total(score.isNotNull()).alias("scored"),
    )


def maintain(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep a trend up to date with a stream of changes."""

    def write(batch: DataFrame, number: int) -> None:
        MaintainedTrend(batch.sparkSession, path, buckets).commit(number, batch)

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
