"""Token counts kept up to date by deltas.

A batch of events inserts, revises or deletes documents. A commit turns it into
signed rows against the state before: an insert adds a row, a delete takes back
the current one, a revision does both. Signed rows are summed by source,
language and tokenizer version, and these sums are the batch's delta; totals are
the sum of all deltas.

A commit writes below ``path`` in the folder of its batch number, by overwriting,
and reads only batches with smaller numbers: one that is begun again after a
failure leaves the same files. A batch counts from the moment its marker is
there, which is written last of all; a commit of a batch that counts does
nothing. Batches are committed in order of their numbers; a smaller one than the
last committed is refused unless it counts already.

Signed rows lie in buckets by a hash of the id. A commit first writes the holding
event of every document, so that an expensive count is made once, and then reads
the state of the buckets that these events touch, no other. How many buckets there
are is written with the first batch and holds from then on, whatever later calls
ask for. ``compact`` folds all batches into one base of rows and sums, which count
from its own marker on; then a commit reads the base and the batches after it.
``vacuum`` deletes what a base has replaced and must not run beside a reader. The
driver sees names of folders only.

``token_count`` gives the tokens of whole texts under a public tokenizer file, the
version of a count being the file's name. A worker reads a file once; texts reach
it in batches of bounded bytes, and no shuffle is needed.

Defined cases: a null or empty text has no tokens; of several events of a document in one batch the one with the
largest ``seq`` holds, a delete before a revision before an insert where they
tie, then the larger counts; an insert of a document that is there revises it;
a revision of one that is not there inserts it; a delete of one that is not
there does nothing; events with a null id are left out; null sources, languages
and versions are groups of their own; null counts are zero; an empty batch
commits an empty delta; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import _ids

KEYS = ("source", "lang", "version")
COUNTS = ("n_tokens", "n_chars")
BUCKETS = 32
_ROW = "doc_id bigint, source string, lang string, version string, n_tokens bigint, n_chars bigint, sign int, bucket int"
_DELTA = "source string, lang string, version string, n_docs bigint, n_tokens bigint, n_chars bigint"


@cache
def _counter(path: str) -> Callable[[str], int]:
    """Tokens of a text: of a piece model (``.model``), or of a vocabulary of words (``.json``)."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        encode = SentencePieceProcessor(model_file=path).encode
        return lambda text: len(encode(text))
    ids_of = _ids(path).__getitem__
    # Four bytes an id.
    return lambda text: sum(map(len, map(ids_of, text.encode().split()))) // 4


def token_count(text: str | Column, path: str) -> Column:
    """The number of tokens of a text column, without special tokens at its ends."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _counter(path)
        for part in texts:
            yield pd.Series([of(t) if t else 0 for t in part], dtype="int64")

    return count(text)


@dataclass
class Tallies:
    """Signed rows, deltas and markers of committed batches below ``path``."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _listed(self, folder: str) -> list[int]:
        """The numbers that the folders below ``folder`` are named by."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = (x.getPath().getName() for x in files.listStatus(where))
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n)

    def _delete(self, folder: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _committed(self) -> list[int]:
        return self._listed("committed")

    def _since(self, batches: list[int]) -> tuple[list[int], list[int]]:
        """The newest base that holds none but these batches, and the batches after it."""
        base = [b for b in self._listed("compacted") if batches and b <= batches[-1]][-1:]
        return base, [b for b in batches if not base or b > base[0]]

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{kind}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders).drop("batch")

    def current(self, batches: list[int] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The row of every document that is there (in ``buckets``): added more often than taken back."""
        base, after = self._since(self._committed() if batches is None else batches)
        rows = self._read("base", _ROW, base).unionByName(self._read("rows", _ROW, after))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", *KEYS, *COUNTS, "bucket").agg(F.sum("sign").alias("net")).filter("net > 0").drop("net")

    def commit(self, batch: int, events: DataFrame) -> None:
        """Apply (op, seq, doc_id, source, lang, version, n_tokens, n_chars) events as ``batch``."""
        done = self._committed()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        self._resolve(batch, events)
        touched = self._listed(f"events/batch={batch}")
        last = self._read("events", f"doc_id bigint, rank int, {_ROW.partition(', ')[2]}", [batch]).drop("sign")
        new = last.select("doc_id", "bucket", "rank", F.struct(*KEYS, *COUNTS).alias("new"))
        old = self.current(done, touched).select("doc_id", F.struct(*KEYS, *COUNTS).alias("old"))
        added = F.when(F.col("rank") < 2, F.struct("new.*", F.lit(1).alias("sign")))
        taken = F.when(F.col("old").isNotNull(), F.struct("old.*", F.lit(-1).alias("sign")))
        signed = new.join(old, "doc_id", "left").select("doc_id", "bucket", F.inline(F.array_compact(F.array(added, taken))))
        self._write("rows", batch, signed)
        rows = self._read("rows", _ROW, [batch])
        sums = [F.sum(F.col("sign").cast("bigint")).alias("n_docs"), *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in COUNTS]]
        self._write("deltas", batch, rows.groupBy(*KEYS).agg(*sums))
        self._mark("committed", batch)
        self._delete(f"events/batch={batch}")

    def _resolve(self, batch: int, events: DataFrame) -> None:
        """Write the holding event of every document of ``batch``, by bucket."""
        fixed = self._listed("settings")
        if not fixed:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/settings/buckets={self.buckets}")
        rank = F.expr("case op when 'delete' then 2 when 'revise' then 1 else 0 end")
        counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
        row = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), rank.alias("rank"), *[F.col(c).cast("string").alias(c) for c in KEYS], *counts)
        last = events.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(row).alias("new"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(fixed[0] if fixed else self.buckets)).cast("int")
        self._write("events", batch, last.select("doc_id", bucket.alias("bucket"), "new.*").drop("seq"))

    def _write(self, kind: str, batch: int, df: DataFrame) -> None:
        out = f"{self.path}/{kind}/batch={batch}"
        if "bucket" in df.columns:
            df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        else:
            df.write.mode("overwrite").parquet(out)

    def _mark(self, kind: str, batch: int) -> None:
        self._write(kind, batch, self.spark.range(1).select(F.lit(batch).alias("n")))

    def compact(self) -> None:
        """Fold all committed batches into one base; done again after a failure, it leaves the same rows."""
        done = self._committed()
        if not done or done[-1] in self._listed("compacted"):
            return
        self._write("base", done[-1], self.current(done).withColumn("sign", F.lit(1)))
        self._write("sums", done[-1], self._totals(done))
        self._mark("compacted", done[-1])

    def vacuum(self) -> None:
        """Delete rows and sums that the newest base has replaced; markers stay."""
        for base in self._listed("compacted")[-1:]:
            for kind, last in (("rows", base), ("deltas", base), ("base", base - 1), ("sums", base - 1)):
                for batch in self._listed(kind):
                    if batch <= last:
                        self._delete(f"{kind}/batch={batch}")

    def _totals(self, batches: list[int]) -> DataFrame:
        base, after = self._since(batches)
        deltas = self._read("sums", _DELTA, base).unionByName(self._read("deltas", _DELTA, after))
        sums = [F.sum(c).alias(c) for c in ("n_docs", *COUNTS)]
        return deltas.groupBy(*KEYS).agg(*sums).filter("n_docs <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens, n_chars) of what is there now."""
        return self._totals(self._committed())
