"""Packing of token sequences: a configuration linear program, rounded.

1. *Pieces.* Each document is encoded, closed with an end id and cut into pieces
   of at most ``CAPACITY`` tokens. A task numbers its pieces of each length.
2. *Histogram.* The number of pieces of each length, at most ``CAPACITY``
   numbers whatever the corpus, is all that reaches the driver.
3. *Configuration LP.* Lengths are put into classes of ``STEP`` tokens. The LP
   (cover the demand of every class with the fewest sequences) is solved by
   multiplicative weights: a class's price falls exponentially with the share
   of its demand that is covered, the best configuration at these prices is
   found by dynamic programming over the capacity, and is taken as often as
   raises its scarcest class by ``EPSILON``. The average is a fractional cover.
   It is improved by simplex steps: as long as a configuration is worth more
   than one sequence at the prices of the cover, it replaces another one.
4. *Rounding.* The whole parts become patterns of exact lengths: each slot takes
   the longest length left in its class, the rest of the capacity is filled
   with the longest lengths that fit. What is left over is packed the same way
   without configurations. Every step uses up a length or a configuration, so
   the plan has a bounded number of rows. The LP is solved for all classes, and
   again with the classes of up to each of ``FILLERS`` steps left out of it, to
   fill what configurations leave free; the plan of the fewest sequences stays.
5. *Placement.* The plan says, for ranges of ranks of each length, which
   sequence and offset they get. The rank of a piece is its number in its task
   plus the pieces of that length in earlier tasks.

Defined cases: a null or empty text is a document of the end id alone; repeated
rows are packed as often as they come; null ids stay null; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

CAPACITY = 4096
END_ID = 1
STEP = 32
EPSILON = 0.1
# Lengths up to so many steps are left to fill what configurations leave free.
FILLERS = (0, 4, 8, 16, 32)
# Simplex steps for each class, at most; a cover is whole after any of them.
PIVOTS = 20
# Words, and words without case and punctuation, whose ids a worker remembers,
# and the longest of them in bytes: some 45 MB.
REMEMBERED = 90_000
REMEMBERED_PLAIN = 150_000
REMEMBERED_BYTES = 64


_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {**{x: chr(x) for x in shown}, **{x: chr(256 + i) for i, x in enumerate(hidden)}}


_BYTE_CHARS = _byte_chars()


class _Ids(dict):
    """Ids of a word, as little-endian 32-bit integers.

    White space always parts the tokens of the vocabulary, so a text's ids are
    those of its words one after the other. Its tokens are lower case, and a
    letter or digit never shares one with punctuation behind it; so a word that
    is new only in these respects is looked up by its parts. A part of lower-case
    letters alone is one unit of the vocabulary's byte-level model already.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.plain: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        plain, tail = word, b""
        if b"<|" not in word:
            plain = word.lower()
            core = plain.rstrip(_PUNCTUATION)
            if core and len(core) < len(plain) and core.decode()[-1].lower()[-1].isalnum():
                plain, tail = core, plain[len(core) :]
        ids = self.plain.get(plain)
        room = len(word) <= REMEMBERED_BYTES
        if ids is None:
            ids = self._new(plain)
            if room and len(self.plain) < REMEMBERED_PLAIN:
                self.plain[plain] = ids
        if tail:
            ids += self[tail]
        if room and len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            ids = [x.id for x in self.merge(text if word.isascii() else word.decode("latin-1").translate(_BYTE_CHARS))]
        else:
            ids = self.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, dtype="<u4").tobytes()


@cache
def _ids(path: str) -> _Ids:
    """The vocabulary that a worker keeps between its tasks."""
    return _Ids(path)


def _pieces(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids_of = TaskContext.get().partitionId(), _ids(path).__getitem__
        end = np.array([end_id], dtype="<u4").tobytes()
        numbers = [0] * (capacity + 1)
        width = 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(ids_of, (text.as_py() or "").encode().split())) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    n = len(piece) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), numbers[n]))
                    numbers[n] += 1
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int64())], names=_NAMES)

    return run


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "number", "part"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint, part bigint"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, numbered by length within the task that made them."""
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        _pieces(tokenizer, capacity, end_id), _SCHEMA
    )


def _best(prices: np.ndarray) -> np.ndarray:
    """How often to take each size, 0 to len - 1, for the highest price at capacity len - 1."""
    value, taken = np.zeros(len(prices)), np.zeros(len(prices), dtype=np.int64)
    for c in range(1, len(prices)):
        with_item = prices[1 : c + 1] + value[c - 1 :: -1][:c]
        k = int(np.argmax(with_item))
        value[c], taken[c] = (with_item[k], k + 1) if prices[k + 1] > 0 and with_item[k] > value[c - 1] else (value[c - 1], 0)
    counts, c = np.zeros(len(prices), dtype=np.int64), len(prices) - 1
    while c > 0:
        counts[taken[c]] += 1
        c -= max(taken[c], 1)
    counts[0] = 0
    return counts


def configurations(demand: np.ndarray, epsilon: float = EPSILON) -> list[tuple[np.ndarray, float]]:
    """A fractional cover of ``demand`` by configurations, heaviest first.

    demand[s] is the number of items of size s; the capacity is its last index.
    """
    want = np.flatnonzero(demand)
    cover, eta = np.zeros(len(demand)), math.log(len(want) + 1) / epsilon / 4
    found: dict[bytes, list] = {}
    while len(open_ := want[cover[want] < 1]):
        prices = np.zeros(len(demand))
        prices[open_] = np.exp(-eta * (cover[open_] - cover[open_].min())) / demand[open_]
        config = _best(prices / prices.max())
        used = np.flatnonzero(config)
        times = min(epsilon * float((demand[used] / config[used]).min()), float(((1 - cover[used]) * demand[used] / config[used]).max()))
        cover[used] += times * config[used] / demand[used]
        found.setdefault(config.tobytes(), [config, 0.0])[1] += times
    return sorted(((c, x) for c, x in found.values()), key=lambda e: -e[1])


def improved(demand: np.ndarray, cover: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, float]]:
    """The cover of least weight, by simplex steps; ``cover`` gives the first configurations to try."""
    want = np.flatnonzero(demand)
    if not len(want):
        return []
    basis = np.diag(((len(demand) - 1) // want).astype(float))
    tried = [config[want].astype(float) for config, _ in cover]
    prices = np.zeros(len(demand))
    for _ in range(PIVOTS * len(want) + len(tried)):
        weight, worth = np.linalg.solve(basis, demand[want]), np.linalg.solve(basis.T, np.ones(len(want)))
        column = tried.pop() if tried else None
        if column is None or column @ worth <= 1 + 1e-9:
            if column is not None:
                continue
            prices[want] = np.maximum(worth, 0)
            column = _best(prices)[want].astype(float)
            if column @ worth <= 1 + 1e-9:
                break
        change = np.linalg.solve(basis, column)
        steps = np.where(change > 1e-9, np.maximum(weight, 0) / np.maximum(change, 1e-9), np.inf)
        basis[:, int(np.argmin(steps))] = column
    out = []
    for column, x in zip(basis.T, np.linalg.solve(basis, demand[want])):
        if x > 1e-9:
            config = np.zeros(len(demand), dtype=np.int64)
            config[want] = column
            out.append((config, float(x)))
    return sorted(out, key=lambda e: -e[1])


def plan(histogram: np.ndarray, step: int = STEP, epsilon: float = EPSILON) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by length and rank.

    histogram[n] is the number of pieces of n tokens. A rank from the first on
    goes to as many sequences further.
    """
    size_of = -(-np.arange(len(histogram)) // step)
    demand = np.bincount(size_of, weights=histogram, minlength=(len(histogram) - 1) // step + 1).astype(np.int64)
    found, tried = [], set()
    for filler in FILLERS:
        part = demand.copy()
        part[: filler + 1] = 0
        if part.tobytes() not in tried:
            tried.add(part.tobytes())
            cover = configurations(part, epsilon)
            found += [_rounded(histogram, step, c) for c in (cover, improved(part, cover))]
    return min(found, key=lambda e: e[0])[1]


def _rounded(histogram: np.ndarray, step: int, cover: list[tuple[np.ndarray, float]]) -> tuple[int, np.ndarray]:
    """The number of sequences, and the plan, that a fractional cover leads to."""
    capacity = len(histogram) - 1
    left, rank = histogram.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0

    def pattern(classes: list[int]) -> dict[int, int]:
        """Exact lengths for all classes but the last, then the longest that fit."""
        use: dict[int, int] = {}
        free = capacity
        for most in itertools.chain((c * step for c in classes[:-1]), itertools.repeat(capacity)):
            have = left[: min(most, free) + 1].copy()
            for n, k in use.items():
                if n < len(have):
                    have[n] -= k
            fits = np.flatnonzero(have > 0)
            if len(fits):
                use[int(fits[-1])] = use.get(int(fits[-1]), 0) + 1
                free -= int(fits[-1])
            elif most >= free:
                break
        return use

    def place(use: dict[int, int], times: int) -> int:
        nonlocal sequence
        times = min(times, *(int(left[n]) // k for n, k in use.items()))
        offset = 0
        for n in sorted(use, reverse=True):
            for _ in range(use[n]):
                rows.append((n, int(rank[n]), sequence, offset))
                rank[n] += times
                offset += n
            left[n] -= use[n] * times
        sequence += times
        return times

    for config, share in cover:
        classes = [s for s in np.flatnonzero(config)[::-1] for _ in range(config[s])]
        wanted = int(share + 1e-6)
        while wanted and left[1:].any():
            wanted -= place(pattern(classes), wanted)
    while left[1:].any():
        place(pattern([]), int(left.sum()))
    return sequence, np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _placed(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shared.value.T
        key = (length << 44) + first
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (n << 44) + rank, side="right") - 1
            columns = [batch.column(c) for c in _NAMES[:5]]
            columns += [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES[:5], "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(documents, tokenizer, capacity, end_id), "pieces")
    per_task = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    shared = documents.sparkSession.sparkContext.broadcast(plan(histogram))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["length", "part"]).withColumn("rank", F.col("number") + F.col("before"))
    return ranked.select(*_NAMES[:5], "rank").mapInArrow(
        _placed(shared), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
