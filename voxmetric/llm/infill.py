"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

A text of n code points is cut at two of them into prefix, middle and suffix,
and written in an order that lets a left-to-right model learn to fill the
middle. The text stays in Arrow's byte buffer. Where all bytes of a span are
ASCII, a code point's place is its byte's place; only the exceptions are
recorded, once per batch: for every multibyte character its code-point position
and the excess bytes up to it. ``searchsorted`` in that list turns a code-point
place into a byte place and back. An ASCII batch has an empty list.

The cuts and the form follow from the SHA-256 of ``<seed>:<doc_id>``, so a lost
task gives the same rows again. There is no shuffle; a batch is bounded in bytes
by the session.

Defined cases: a null text is an empty one; empty texts, and texts that contain
a sentinel, stay plain; a null id is hashed as no digits (``1:``); repeated rows
are each transformed, alike if their ids are; an empty table gives an empty
result. A text must leave room for the sentinels below the 2 GiB that Spark
allows a string. Extra columns are kept, unless named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
OUTPUTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_NAMES = ["n", "form", "prefix_chars", "middle_chars", "output"]


class Exceptions:
    """Places of code points in a UTF-8 buffer, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.total = np.concatenate([[0], np.cumsum(excess)])
        self.byte_places = lead
        self.places = lead - self.total[:-1]

    def to_byte(self, places: np.ndarray) -> np.ndarray:
        """Byte places of code-point places, both counted from the buffer's start."""
        return places + self.total[np.searchsorted(self.places, places)]

    def to_code_point(self, at: np.ndarray) -> np.ndarray:
        """Code-point places of the byte places of first bytes."""
        return at - self.total[np.searchsorted(self.byte_places, at)]


def check_sentinels(sentinels: Sequence[str]) -> None:
    """Raise unless an output can be taken apart again at its sentinels."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            ends = any(a.endswith(b[:n]) for n in range(1, len(b)))
            if not a or ends or (i != j and a in b):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def _draws(seed: int, ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 4).astype(np.int64)


def _transformed(texts: pa.Array, ids: list, seed: int, sentinels: Sequence[str], plain_from: int, spm_below: int) -> list:
    """Columns n, form, prefix_chars, middle_chars and output of a batch."""
    rows = len(texts)
    if not rows:
        return [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())]
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    raw = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    data = memoryview(raw)[low:high] if raw is not None else memoryview(b"")
    at = offsets - low
    index = Exceptions(np.frombuffer(data, dtype=np.uint8))
    edges = index.to_code_point(at)
    n = np.diff(edges)
    draws = _draws(seed, ids)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    bytes_at = np.column_stack([at[:-1], index.to_byte(edges[:-1] + cuts[:, 0]), index.to_byte(edges[:-1] + cuts[:, 1]), at[1:]])
    p, s, m = (x.encode() for x in sentinels)
    form, output = [], []
    for (a, b, c, d), (_, _, h3, h4) in zip(bytes_at.tolist(), draws.tolist()):
        text = data[a:d]
        whole = bytes(text)
        if a == d or h3 % 100 >= plain_from or p in whole or s in whole or m in whole:
            form.append("plain")
            output.append(whole)
            continue
        prefix, middle, suffix = data[a:b], data[b:c], data[c:d]
        if h4 % 100 < spm_below:
            form.append("spm")
            output.append(b"".join((s, suffix, p, prefix, m, middle)))
        else:
            form.append("psm")
            output.append(b"".join((p, prefix, s, suffix, m, middle)))
    plain = np.array([f == "plain" for f in form])
    return [
        pa.array(n), pa.array(form, pa.string()), pa.array(cuts[:, 0], mask=plain),
        pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(output, pa.binary()).cast(pa.string()),
    ]


def transform(
    documents: DataFrame, seed: int = 1, sentinels: Sequence[str] = SENTINELS,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``documents`` with n, form, prefix_chars, middle_chars and output.

    Of 100 texts about ``plain_from`` are cut, of 100 of those about
    ``spm_below`` in the order suffix, prefix, middle (spm), the others in the
    order prefix, suffix, middle (psm).
    """
    check_sentinels(sentinels)
    kept = documents.select([c for c in documents.columns if c.lower() not in _NAMES])
    id_at, text_at = kept.columns.index("doc_id"), kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(text_at), batch.column(id_at).to_pylist()
            found = _transformed(texts, ids, seed, sentinels, plain_from, spm_below)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *_NAMES])

    added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{added}, {OUTPUTS}")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made from, by its form; null for a null output."""
    check_sentinels(sentinels)
    pattern = "|".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" for x in sentinels)
    parts = F.split(output, pattern, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
