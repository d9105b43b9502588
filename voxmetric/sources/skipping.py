"""Tables with side tables that tell which files a query has to read.

Beside the rows of every append stand, made from the written files:

- ``themes``: for each (theme, file) bitmaps of the row numbers that have it, one
  for each 32,768 rows. A theme's files, and its count, follow from these alone.
- ``trigrams``: for each file the set of the hashed byte trigrams of its
  lower-cased texts, 2^17 bits as 64-bit words. A text that holds a needle holds
  all its trigrams, so a file that lacks one is skipped; the others are searched.
- ``days``: rows per day of the time column, the order statistics of paging.
- ``files``: the files whose entries are complete. It is written last, and a file
  that is not in it (an append that failed half way) is read by every query.

What the driver holds is lists of files, like the listing of a folder itself, and
a page's counts of days, seconds of some days, and id ranges.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BITS = 17
_WORDS = 1 << (BITS - 6)
_FACTOR = 0x9E3779B97F4A7C15
# A page's range is refined while it holds more than so many times its rows.
SLACK, ID_RANGES = 4, 1024


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hash of the three bytes that begin at each place but the last two."""
    wide = data.astype(np.uint64)
    value = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    return ((value * np.uint64(_FACTOR)) >> np.uint64(64 - BITS)).astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, word, bits) of the trigrams of a task's texts."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        files, texts = batch.column("file").dictionary_encode(), batch.column("low").fill_null("").cast(pa.large_string())
        if not batch.num_rows or texts.buffers()[2] is None:
            continue
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + batch.num_rows + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        kinds = files.indices.to_numpy()
        # Runs of rows of one file; trigrams across the ends of texts only add bits.
        edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            flags = found.setdefault(files.dictionary[int(kinds[a])].as_py(), np.zeros(1 << BITS, dtype=bool))
            for lo in range(int(at[a]), int(at[b]), 1 << 22):
                part = data[lo : min(lo + (1 << 22) + 2, int(at[b]))]
                if len(part) > 2:
                    flags[trigrams(part)] = True
    for file, flags in found.items():
        words = np.packbits(flags, bitorder="little").view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(used)), pa.array(used.astype(np.int32)), pa.array(words[used])], names=["file", "word", "bits"]
        )


def _needle(text: str) -> dict[int, int]:
    """Word number to the bits that a file with the lower-cased needle has set."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    masks: dict[int, int] = {}
    for h in trigrams(data).tolist() if len(data) > 2 else ():
        masks[h // 64] = masks.get(h // 64, 0) | 1 << h % 64
    return {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}


class IndexedTable:
    """A folder with rows and their side tables; each column is indexed if it is named."""

    def __init__(
        self, spark: SparkSession, path: str, *, themes: str | None = None, text: str | None = None,
        stamp: str | None = None, key: str = "id",
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.themes, self.text, self.stamp, self.key = themes, text, stamp, key

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _side(self, name: str) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(name))
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self._folder(name)) if files.exists(where) else None

    def append(self, rows: DataFrame) -> None:
        """Write rows, then their entries in the side tables."""
        batch = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(self._folder(batch))
        self.index(batch)

    def index(self, batch: str) -> None:
        """Entries of the files in one written folder."""
        where = self.spark.read.parquet(self._folder(batch))
        file, place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
        if self.themes:
            rows = where.select(file, place, F.explode(F.array_distinct(F.array_compact(self.themes))).alias("theme"))
            bitmaps = rows.groupBy("theme", "file", F.bitmap_bucket_number("place").alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("rows")
            )
            # Sorted, so that a look-up reads the row groups of its theme only.
            self._add(bitmaps.repartitionByRange("theme").sortWithinPartitions("theme", "file"), "themes")
        if self.text:
            words = where.select(file, F.lower(self.text).alias("low")).mapInArrow(_signatures, "file string, word int, bits bigint")
            merged = words.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
            self._add(merged.repartitionByRange("word").sortWithinPartitions("word", "file"), "trigrams")
        if self.stamp:
            self._add(where.groupBy(F.to_date(self.stamp).alias("day")).agg(F.count(F.lit(1)).alias("n")), "days")
        self._add(self.spark.createDataFrame([(f,) for f in where.inputFiles()], "file string"), "files")

    def _add(self, entries: DataFrame, name: str) -> None:
        entries.write.mode("append").parquet(self._folder(name))

    def files(self) -> list[str]:
        """All data files."""
        root = self.spark.read.option("recursiveFileLookup", True)
        return sorted(root.parquet(self._folder("rows")).inputFiles())

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some files."""
        reader = self.spark.read.option("recursiveFileLookup", True)
        everything = reader.parquet(self._folder("rows"))
        if files is None:
            return everything
        if not files:
            return everything.limit(0)
        return self.spark.read.schema(everything.schema).parquet(*files)

    def _unindexed(self) -> set[str]:
        known = self._side("files")
        done = set() if known is None else {_plain(r.file) for r in known.select("file").collect()}
        return {f for f in self.files() if _plain(f) not in done}

    def _chosen(self, hits: set[str]) -> list[str]:
        wanted, late = {_plain(f) for f in hits}, self._unindexed()
        return [f for f in self.files() if _plain(f) in wanted or f in late]

    def files_with_theme(self, theme: str) -> list[str]:
        entries = self._side("themes")
        hits = set() if entries is None else {r.file for r in entries.filter(F.col("theme") == theme).select("file").distinct().collect()}
        return self._chosen(hits)

    def has_theme(self, theme: str) -> DataFrame:
        """The rows whose array holds the theme."""
        return self.rows(self.files_with_theme(theme)).filter(F.array_contains(self.themes, theme))

    def theme_counts(self) -> DataFrame:
        """(theme, n): rows of each theme, from the bitmaps alone."""
        return self._side("themes").groupBy("theme").agg(F.sum(F.bitmap_count("rows")).alias("n"))

    def files_with_text(self, needle: str) -> list[str]:
        """Files that may hold the needle; needles below three bytes may be anywhere."""
        masks, entries = _needle(needle.lower()), self._side("trigrams")
        if not masks:
            return self.files()
        hits: set[str] = set()
        if entries is not None:
            mask = F.create_map(*[F.lit(x) for pair in masks.items() for x in pair])[F.col("word")]
            whole = entries.filter(F.col("word").isin(*masks)).filter(F.col("bits").bitwiseAND(mask) == mask)
            found = whole.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(masks))
            hits = {r.file for r in found.collect()}
        return self._chosen(hits)

    def search(self, needle: str) -> DataFrame:
        """The rows whose text holds the needle, in any case."""
        low = needle.lower()
        return self.rows(self.files_with_text(needle)).filter(F.lower(self.text).contains(low))

    def search_report(self, needle: str) -> DataFrame:
        """(needle, files, read, skipped_share) of a search."""
        every, read = len(self.files()), len(self.files_with_text(needle))
        row = (needle, every, read, (every - read) / every if every else 0.0)
        return self.spark.createDataFrame([row], "needle string, files bigint, read bigint, skipped_share double")

    # ------------------------------------------------------------- paging

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``, newest first, then by key; null times last.

        The day counts give the days that hold the page. While those hold much
        more, counts of their seconds, then of key ranges in a second, are taken
        from the rows of that range. Only the range is sorted.
        """
        rows, days = self.rows(), self._side("days")
        if self._unindexed() or days is None:
            return self._sorted(rows).offset(offset).limit(limit)
        totals = days.groupBy("day").agg(F.sum("n").alias("n")).collect()
        found = _range([(r.day, r.n) for r in totals], offset, limit, newest=True)
        if found is None:
            return rows.limit(0)
        (first, last), held, offset = found
        stamp = F.col(self.stamp)
        if first is None or last is None:
            rows = rows if first is not None else rows.filter(stamp.isNull())
            rows = rows if first is None else rows.filter(stamp.isNull() | (stamp < F.lit(first + dt.timedelta(days=1))))
        else:
            rows = rows.filter((stamp >= F.lit(last)) & (stamp < F.lit(first + dt.timedelta(days=1))))
            for part, newest in ((F.unix_seconds(stamp.cast("timestamp")), True), (None, False)):
                if held <= SLACK * (limit + 1):
                    break
                if part is None:
                    low, high = rows.agg(F.min(self.key), F.max(self.key)).first()
                    part = F.floor((F.col(self.key) - low) / max(-(-(high - low + 1) // ID_RANGES), 1)) if _one_moment(rows, stamp) else None
                    if part is None:
                        break
                counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
                (first, last), held, offset = _range([(r.part, r.n) for r in counts], offset, limit, newest)
                rows = rows.filter(part.between(F.lit(min(first, last)), F.lit(max(first, last))))
        return self._sorted(rows).offset(offset).limit(limit)

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc_nulls_last(self.stamp), F.asc(self.key))


def _one_moment(rows: DataFrame, stamp: Column) -> bool:
    low, high = rows.agg(F.min(stamp), F.max(stamp)).first()
    return low == high


def _range(counts: list, offset: int, limit: int, newest: bool):
    """((first, last) keys of the page in reading order, rows in that range, offset in it)."""
    order = sorted((c for c in counts if c[0] is not None), reverse=newest) + [c for c in counts if c[0] is None]
    seen, first, last, before, held = 0, None, None, 0, 0
    started = False
    for key, n in order:
        if seen + n > offset and seen < offset + max(limit, 1):
            if not started:
                started, first, before = True, key, seen
            last, held = key, held + n
        seen += n
    return ((first, last), held, offset - before) if started else None


def _plain(file: str) -> str:
    """A file's path without its scheme, which listings and rows write differently."""
    return "/" + file.split(":", 1)[-1].lstrip("/") if ":" in file.split("/", 1)[0] else file
