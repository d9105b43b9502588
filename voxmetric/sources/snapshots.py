"""Keyed tables with atomic commits, delta layers and compaction.

A table is a folder with immutable data folders and small numbered manifests. A
commit first writes its rows into a new folder, partitioned by a hash of the
key, and then publishes them by creating the next manifest; the highest manifest
is the table. A failure before that leaves the old table, and what it wrote is
never read. Creating an existing manifest fails, so of two writers that started
from one version only one commits. (This needs a file system whose rename is
atomic and does not overwrite, like HDFS.)

The manifest holds the key, the number of key buckets and, for each bucket, its
layers, oldest first: one base and the deltas on it. An upsert adds a delta with
the incoming rows alone, so its work grows with them and not with the table. A
read takes buckets of one layer as they are and merges the others by key. When a
bucket has more than ``MOST_LAYERS``, the commit merges it into a new base.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.nps import top_per_group
from ..operators.quality import one_per_key, with_parent

BUCKET, LAYER = "key_bucket", "_layer"
MOST_LAYERS = 8


class CommitConflict(RuntimeError):
    """Another commit was published first."""


class Snapshots:
    """Manifests of one table folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        where = self._path("manifests")
        if not self._files.exists(where):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(where)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or the one of a version."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{number:012d}.json").first()[0])

    def publish(self, manifest: dict) -> None:
        """Make a manifest the table, if its version is still free."""
        name = f"manifests/{manifest['version']:012d}.json"
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        self._files.mkdirs(self._path("manifests"))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(self._path(name)) or not self._files.rename(draft, self._path(name)):
            self._files.delete(draft, False)
            raise CommitConflict(f"version {manifest['version']} of {self.path} exists")

    def delete(self, folder: str) -> None:
        self._files.delete(self._path(folder), True)

    def folders(self, parent: str) -> list[str]:
        where = self._path(parent)
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []


class KeyedTable:
    """A table with one row per key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Snapshots(spark, path)
        self.path = self.files.path

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int, notes: dict | None = None) -> KeyedTable:
        """New table; ``key`` and ``buckets`` are kept with it. Of rows with one key one stays."""
        table = cls(rows.sparkSession, path)
        if table.files.versions():
            raise FileExistsError(f"a table exists at {path}")
        layer, touched = table._write(one_per_key(rows, key), key, buckets)
        layers = {str(b): [layer] for b in touched}
        first = {"version": 1, "key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "layers": layers}
        table.files.publish((notes or {}) | first)
        return table

    def bucket_of(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(manifest["key"]), F.lit(manifest["buckets"])).cast("int")

    def _write(self, rows: DataFrame, key: str, buckets: int) -> tuple[str, list[int]]:
        """(folder, buckets that received rows) of a new layer."""
        layer = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, self.bucket_of({"key": key, "buckets": buckets}))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{layer}")
        found = [n.split("=")[1] for n in self.files.folders(layer) if n.startswith(f"{BUCKET}=")]
        return layer, sorted(map(int, found))

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the newest or of an earlier version."""
        return self._rows(self.files.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        wanted = None if buckets is None else set(buckets)
        layers = {int(b): x for b, x in manifest["layers"].items() if wanted is None or int(b) in wanted}

        def scan(chosen: dict[int, list[str]], number: int) -> DataFrame:
            paths = [f"{self.path}/{x[number]}/{BUCKET}={b}" for b, x in chosen.items() if len(x) > number]
            return self.spark.read.schema(schema).parquet(*paths)

        single = {b: x for b, x in layers.items() if len(x) == 1}
        several = {b: x for b, x in layers.items() if len(x) > 1}
        frames = [scan(single, 0)] if single else []
        if several:
            most = max(map(len, several.values()))
            parts = [scan(several, n).withColumn(LAYER, F.lit(n)) for n in range(most)]
            merged = functools.reduce(DataFrame.unionByName, parts)
            frames.append(top_per_group(merged, [manifest["key"]], [F.desc(LAYER)], 1).drop("rank", LAYER))
        if not frames:
            return self.spark.createDataFrame([], schema)
        return functools.reduce(DataFrame.unionByName, frames)

    def upsert(
        self,
        incoming: DataFrame,
        parents: DataFrame | None = None,
        parent_key: str = "id",
        touch: str | None = "updated_at",
        newest: Sequence[str] = (),
        buckets: int | None = None,
        notes: dict | None = None,
    ) -> int:
        """Insert or replace rows by key; returns the new version.

        Incoming rows without a parent are left out, and of those with one key
        the newest by ``newest`` stays. ``touch`` names a column set to the write
        time. ``buckets`` may be given to check what the caller believes. ``notes``
        are entries of the manifest that are committed with the rows.
        """
        manifest = self.files.manifest()
        key, held = manifest["key"], manifest["buckets"]
        if buckets is not None and buckets != held:
            raise ValueError(f"the table has {held} key buckets, not {buckets}")
        columns = [f["name"] for f in manifest["schema"]["fields"]]
        if sorted(incoming.columns) != sorted(columns):
            raise ValueError(f"columns {incoming.columns}, the table has {columns}")
        if parents is not None:
            incoming = with_parent(incoming, parents, key, parent_key)
        if touch and touch in columns:
            incoming = incoming.withColumn(touch, F.current_timestamp())
        kinds = {f.name: f.dataType for f in self._rows(manifest).schema}
        rows = one_per_key(incoming, key, newest).select([F.col(c).cast(kinds[c]).alias(c) for c in columns])
        layer, touched = self._write(rows, key, held)
        layers = {b: list(x) for b, x in manifest["layers"].items()}
        for b in touched:
            layers.setdefault(str(b), []).append(layer)
        after = manifest | (notes or {}) | {"version": manifest["version"] + 1, "layers": layers}
        long = [int(b) for b, x in layers.items() if len(x) > MOST_LAYERS]
        if long:
            after = self._merged(after, long)
        self.files.publish(after)
        return after["version"]

    def _merged(self, manifest: dict, buckets: Sequence[int]) -> dict:
        """The manifest with the layers of some buckets merged into a new base."""
        layer, _ = self._write(self._rows(manifest, buckets), manifest["key"], manifest["buckets"])
        return manifest | {"layers": manifest["layers"] | {str(b): [layer] for b in buckets}}

    def compact(self) -> int:
        """Merge all buckets that have deltas; returns the version."""
        manifest = self.files.manifest()
        long = [int(b) for b, x in manifest["layers"].items() if len(x) > 1]
        if not long:
            return manifest["version"]
        after = self._merged(manifest | {"version": manifest["version"] + 1}, long)
        self.files.publish(after)
        return after["version"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions uses, and older manifests.

        Not to be run while a reader uses an older version or a commit is under way.
        """
        versions = self.files.versions()
        kept = [self.files.manifest(v) for v in versions[-keep:]]
        used = {layer for m in kept for x in m["layers"].values() for layer in x}
        gone = [f"data/{n}" for n in self.files.folders("data") if f"data/{n}" not in used]
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v:012d}.json")
        for folder in gone:
            self.files.delete(folder)
        return gone
