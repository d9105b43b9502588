"""Repeated passages: seed and extend over winnowed anchors.

A passage is repeated when a window of ``LENGTH`` consecutive words of one text
has the same words as a window that starts anywhere else, in the same text or
another. All copies are removed, the first one included.

1. *Seeds.* Of the k-grams of each text, winnowing keeps those that are the
   smallest of ``LENGTH - k + 1`` consecutive ones. Any window of ``LENGTH``
   words holds at least one of them, and equal windows hold equal ones, so only
   windows around an anchor that occurs twice can be repeated.
   A text as a whole is a seed as well: all windows of a text that occurs twice
   are repeated.
2. *Extension.* From each anchor that occurs twice to the left and to the right,
   every window whose smallest k-gram it is, is matched by a 96-bit hash of its
   words. Of equal texts one block does this.
3. *Maximal repeats.* Overlapping matched windows are joined to the longest
   runs; their words go.

Texts are dealt into blocks of bounded size by a hash of the row. Anchors and
windows are first made distinct within a block, and what returns to a block is
the list of its own anchors (windows) that were found twice. So a passage in a
third of all documents is one row per block, no pair of documents is ever
formed, and no group holds more than a block.

Defined cases: a null text has no words and comes back empty; shorter texts
than a window stay whole (words joined by one space); rows that repeat each
other are copies of each other; null ids and extra columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .storage import written

LENGTH = 35
SEED_WORDS = 10
BLOCK_BYTES = 4 << 20
_BLOCK = "_repeat_block"


def _least(w: W.Words, h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams, and of the smallest one of each window (0: no window)."""
    g = W.window_hashes(h, k)
    return g, np.where(W.fits(w, length), _sliding(g, length - k + 1, np.minimum), np.uint64(0))


def _anchors(w: W.Words, h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams: the smallest of some window."""
    g, least = _least(w, h, length, k)
    most = _sliding(least[::-1], length - k + 1, np.maximum)[::-1]
    at = np.flatnonzero((most == g) & (most > 0))
    return at, g[at]


def _sliding(x: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """pick over x[i : i + n], shorter at the end, by doubling."""
    out, size = x.copy(), 1
    while size < n:
        step = min(size, n - size)
        if step < len(out):
            out[:-step] = pick(out[:-step], out[step:].copy())
        size += step
    return out


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    heads = np.flatnonzero(new)
    return [k[heads] for k in keys], np.diff(np.append(heads, len(order)))


def _texts(w: W.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index and the two parts of a 96-bit hash of each text that has a window."""
    at = np.flatnonzero(w.counts >= length)
    h = [xxhash.xxh3_128_intdigest(w.raw[w.offsets[i] : w.offsets[i + 1]].tobytes()) for i in at]
    low = np.array([x & ((1 << 64) - 1) for x in h], dtype=np.uint64)
    return at, low, np.array([x >> 96 | 1 for x in h], dtype=np.uint64)


def _rows(a: np.ndarray, b: np.ndarray, block: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a.view(np.int64)), pa.array(b.astype(np.uint32).view(np.int32)),
            pa.array(block.astype(np.int64)), pa.array(n.astype(np.int64)),
        ],
        names=["a", "b", "block", "n"],
    )


_ROWS = "a bigint, b int, block bigint, n bigint"


def _seeds(length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            found = []
            for i, _, w in W.slices(batch.column("text")):
                at, g = _anchors(w, w.hashes(), length, k)
                text_of = np.searchsorted(w.first, at, side="right") - 1
                found.append((g, np.zeros_like(g), blocks[i + text_of]))
                at, low, high = _texts(w, length)
                found.append((low, high, blocks[i + at]))
            if found:
                (a, b, block), n = _distinct(*(np.concatenate(x) for x in zip(*found)))
                yield _rows(a, b, block, n)

    return run


def _keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and whether the block is the first of its key, sorted by a."""
    a = rows["a"].to_numpy().view(np.uint64)
    order = np.argsort(a, kind="stable")
    b = rows["b"].to_numpy().view(np.uint32).astype(np.uint64)
    return a[order], b[order], rows["first"].to_numpy(zero_copy_only=False)[order]


def _copies(w: W.Words, length: int, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Texts that occur twice or more, and those of them that another block extends."""
    a, b, first = known
    copy, elsewhere = np.zeros(len(w.counts), dtype=bool), np.zeros(len(w.counts), dtype=bool)
    if len(a):
        at, low, high = _texts(w, length)
        place = np.minimum(np.searchsorted(a, low), len(a) - 1)
        hit = (a[place] == low) & (b[place] == high)
        copy[at[hit]], elsewhere[at[hit]] = True, ~first[place[hit]]
    return copy, elsewhere


def _windows(length: int, k: int) -> Callable:
    def run(texts: pa.Table, seeds: pa.Table) -> pa.Table:
        known = _keys(seeds)
        found = []
        for _, _, w in W.slices(texts["text"].combine_chunks()) if len(known[0]) else ():
            copy, elsewhere = _copies(w, length, known)
            h = w.hashes()
            least = _least(w, h, length, k)[1]
            begins = _member(least, known[0]) & (least > 0) & ~np.repeat(elsewhere, w.counts)
            if not begins.any():
                continue
            twice = 1 + np.repeat(copy, w.counts)[begins].astype(np.int64)
            a, b = (W.window_hashes(x, length)[begins] for x in (h, w.hashes(1)))
            found.append((a, b & np.uint64(0xFFFFFFFF), twice))
        if not found:
            return pa.Table.from_batches([_rows(*(np.zeros(0, np.uint64),) * 4)])
        a, b, twice = (np.concatenate(x) for x in zip(*found))
        (a, b, twice), n = _distinct(a, b, twice)
        block = np.full(len(a), texts[_BLOCK][0].as_py())
        return pa.Table.from_batches([_rows(a, b, block, n * twice)])

    return run


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x if len(known) else np.zeros(len(x), dtype=bool)


def _strip(length: int) -> Callable:
    def run(rows: pa.Table, repeated: pa.Table) -> pa.Table:
        known = a, b, _ = _keys(repeated)
        texts = rows["text"].combine_chunks()
        kept, n_words, n_removed, runs = [], [], [], []
        for i, j, w in W.slices(texts):
            gone = np.zeros(len(w), dtype=bool)
            if len(a):
                whole = np.flatnonzero(W.fits(w, length))
                h = W.window_hashes(w.hashes(), length)[whole]
                whole, h = whole[hit := _member(h, a)], h[hit]
                if len(whole):
                    other = W.window_hashes(w.hashes(1), length)[whole]
                    begins = np.zeros(len(w), dtype=bool)
                    begins[whole[b[np.searchsorted(a, h)] == other & np.uint64(0xFFFFFFFF)]] = True
                    gone = W.covered(begins, length)
                gone |= np.repeat(_copies(w, length, known)[0], w.counts)
            n_words.append(w.counts)
            n_removed.append(w.per_text(gone))
            for text, lo, hi, n in zip(texts.slice(i, j - i), w.first[:-1], w.first[1:], n_removed[-1]):
                parts = (text.as_py() or "").encode().split()
                if n:
                    edge = np.flatnonzero(np.diff(gone[lo:hi], prepend=False, append=False))
                    runs.append([{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    parts = [parts[x] for x in np.flatnonzero(~gone[lo:hi])]
                else:
                    runs.append([])
                kept.append(b" ".join(parts).decode())
        out = rows.drop_columns([_BLOCK])
        out = out.set_column(out.column_names.index("text"), "text", pa.array(kept, pa.string()))
        for name, parts in (("n_words", n_words), ("n_removed", n_removed)):
            values = np.concatenate(parts) if parts else np.zeros(0)
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return out.append_column("repeats", pa.array(runs, kind))

    return run


def _seen_twice(counts: DataFrame) -> DataFrame:
    """(block, a, b, first) for keys whose counts add up to two or more over all blocks.

    A key has a row per block, or per task and block, and is gathered as the set
    of its blocks.
    """
    return (
        counts.groupBy("a", "b")
        .agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))
        .filter("n > 1")
        .withColumn("least", F.array_min("blocks"))
        .select(F.explode("blocks").alias(_BLOCK), "a", "b", "least")
        .select(_BLOCK, "a", "b", (F.col(_BLOCK) == F.col("least")).alias("first"))
    )


def strip_repeats(documents: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents with ``text`` reduced to its words outside repeated windows.

    Added columns: ``n_words`` before, ``n_removed``, and ``repeats``, the
    maximal repeats as word ranges of the text as it came. An added column
    replaces one of the same name.
    """
    added = ["n_words", "n_removed", "repeats"]
    documents = documents.drop(*added, _BLOCK)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))
    dealt = documents.withColumn(_BLOCK, block)
    seeds = documents.select("text", block.alias("block")).mapInArrow(
        _seeds(length, seed_words), _ROWS
    )
    seeds = written(_seen_twice(seeds), "seeds")
    windows = (
        dealt.select("text", _BLOCK)
        .groupBy(_BLOCK)
        .cogroup(seeds.groupBy(_BLOCK))
        .applyInArrow(_windows(length, seed_words), _ROWS)
    )
    schema = T.StructType(
        [f for f in documents.schema.fields]
        + [T.StructField(c, T.LongType()) for c in added[:2]]
        + [T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])))]
    )
    # A window has one row per block: summing before the shuffle would only widen it.
    repeated = _seen_twice(windows.repartition("a", "b")).unionByName(seeds.filter("b <> 0"))
    return (
        dealt.groupBy(_BLOCK)
        .cogroup(repeated.groupBy(_BLOCK))
        .applyInArrow(_strip(length), schema)
    )
