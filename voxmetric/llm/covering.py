"""Near-duplicate classes: SimHash fingerprints under covering LSH.

*Fingerprint.* Every 3-word shingle of the text (A-Z lower-cased, words joined
by one space, repeats included) is hashed by XXH64 with seed 42; a bit of the
fingerprint is set where it is set in over half the hashes.

*Covering masks.* Each of the 64 bit places gets a nonzero vector of 4 bits, in
turn; for each of the 15 nonzero v, table v keeps the places whose vector has
odd inner product with v. For three differing places there is a nonzero v whose
products with all three vectors are even (three equations, four unknowns), so
every pair within radius 3 agrees on all kept places of some table.

*Links.* Distinct fingerprints (one row per class of equal ones) are grouped by
(table, kept bits). A bucket is searched in numpy and returns a star per linked
set, no pairs. A bucket of more than ``BUCKET`` fingerprints is dealt out by the
places that its mask drops: cut into four parts, at least one part agrees in
every pair within the radius. After ``LEVELS`` such rounds at most 13 places
differ inside a bucket, so its size is bounded whatever the data.

*Classes.* Stars are joined over all buckets by taking the least label of the
neighbours and jumping along labels, in written rounds, until nothing changes.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; null ids take part but never name a class unless the class has
no other id; repeated rows stay repeated; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .storage import written

RADIUS = 3
SEED = 42
SHINGLE = 3
BUCKET = 4096
LEVELS = 3
_PARTS = RADIUS + 1


def masks() -> list[int]:
    """The kept places of the 15 tables."""
    vectors = [i % (2 ** (RADIUS + 1) - 1) + 1 for i in range(64)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 2 ** (RADIUS + 1))
    ]


def _refined(kept: int) -> list[int]:
    """The kept places of a table and, in turn, of a quarter of those it drops."""
    dropped = [i for i in range(64) if not kept >> i & 1]
    return [kept | sum(1 << i for i in dropped[p::_PARTS]) for p in range(_PARTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(text: str | None) -> int:
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter(
        (hashed(line[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())),
        dtype="<u8",
        count=len(parts) - SHINGLE + 1,
    )
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([_fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and its fingerprint as a signed long."""
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) text_key", "text").mapInArrow(
        _fingerprints, "doc_id bigint, text_key bigint, fp bigint"
    )


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for the members of each linked set but its centre."""
    left, out = np.sort(fps), []
    while len(left):
        centre, left = left[0], left[1:]
        front = np.array([centre], dtype=np.uint64)
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for x in front:
                near |= np.bitwise_count(left ^ x) <= RADIUS
            front, left = left[near], left[~near]
            out.append((front, np.full(len(front), centre)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        found = [_stars(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        if found:
            member, centre = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(member.view(np.int64)), pa.array(centre.view(np.int64))], names=["fp", "other"]
            )


def _keyed(fps: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """A row (t, key, fp) per fingerprint and (number, mask) of a table."""
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in tables])
    return fps.select("fp", F.inline(entries))


def links(fps: DataFrame, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """(fp, other) stars that connect all distinct ``fp`` within the radius."""
    tables, out = dict(enumerate(masks())), []
    rows = _keyed(fps, list(tables.items()))
    for level in range(levels + 1):
        sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = rows.join(sizes, ["t", "key"])
        last = level == levels
        small = rows if last else rows.filter(F.col("size") <= bucket)
        out.append(
            small.groupBy("t", "key")
            .agg(F.collect_list("fp").alias("fps"))
            .select("fps")
            .mapInArrow(_star_batches, "fp bigint, other bigint")
        )
        if last or sizes.filter(F.col("size") > bucket).isEmpty():
            break
        finer = {t * _PARTS + p: m for t, mask in tables.items() for p, m in enumerate(_refined(mask))}
        big = rows.filter(F.col("size") > bucket).select("fp", "t")
        cells = F.array(
            *[
                F.when(
                    F.col("t") == t // _PARTS,
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")),
                )
                for t, m in finer.items()
            ]
        )
        rows = written(big.select("fp", F.inline(F.array_compact(cells))), "buckets")
        tables = finer
    return reduce(DataFrame.unionByName, out).distinct()


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(fp, component, at): the least name reachable and the fp that has it, for fps with a link.

    Rounds of neighbour minimum and label jump. The label side of each join has
    one row per fingerprint, so a hub splits like any skewed join.
    """
    both = written(edges.unionByName(edges.select(F.col("other").alias("fp"), F.col("fp").alias("other"))), "links")
    label = F.struct(F.col("name").isNull().alias("none"), "name", F.col("fp").alias("at"))
    labels = written(names.join(both.select("fp").distinct(), "fp").select("fp", label.alias("label")), "labels")
    while True:
        seen = (
            both.join(labels.withColumnRenamed("fp", "other"), "other")
            .groupBy("fp")
            .agg(F.min("label").alias("near"))
        )
        near = written(labels.join(seen, "fp").select("fp", "label", F.least("label", "near").alias("near")), "near")
        ahead = near.select(F.col("fp").alias("at"), F.col("near").alias("jump"))
        least = F.least("near", "jump")
        after = near.withColumn("at", F.col("near.at")).join(ahead, "at")
        after = written(after.select("fp", least.alias("label"), (least != F.col("label")).alias("moved")), "labels")
        labels = after.select("fp", "label")
        if after.filter("moved").isEmpty():
            return labels.select("fp", F.col("label.name").alias("component"), F.col("label.at").alias("at"))


def classes(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_key, fp, component_id, class_fp) for every document."""
    prints = written(fingerprints(documents), "fingerprints")
    names = prints.groupBy("fp").agg(F.min("doc_id").alias("name"))
    found = components(links(names.select("fp"), bucket), names)
    owner = names.join(found, "fp", "left").select(
        "fp", F.coalesce("component", "name").alias("component_id"), F.coalesce("at", "fp").alias("class_fp")
    )
    # Written, so that both sides of the join are plain rows and a hot key is split.
    return prints.join(written(owner, "owners"), "fp").select("doc_id", "text_key", "fp", "component_id", "class_fp")


def representatives(documents: DataFrame) -> DataFrame:
    """One document of each class, in its own columns.

    It is the one with the least id, and of rows with that id the one with the
    least hash of its text; a row without an id only where no row of the class
    has one. Of rows that share id and text the least by all columns that can be
    compared stays.
    """
    found = written(classes(documents), "classes")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = found.groupBy("class_fp").agg(F.min(key).alias("key")).select(F.col("key.doc_id").alias("_id"), F.col("key.text_key").alias("_key"))
    keyed = documents.withColumns({"_id": F.col("doc_id").cast("bigint"), "_key": F.xxhash64("text")})
    same = keyed["_id"].eqNullSafe(chosen["_id"]) & (keyed["_key"] == chosen["_key"])
    rows = keyed.join(chosen, same, "left_semi")
    rest = [f.name for f in documents.schema if not isinstance(f.dataType, (MapType, VariantType))]
    first = Window.partitionBy("_id", "_key").orderBy(*rest)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select(documents.columns)
