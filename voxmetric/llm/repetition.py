"""Quality rules on repetition coverage.

For every text, the share of its word characters that lie inside repeated
n-grams of several lengths, and inside repeated lines. n-grams are found by
rolling hashes over the word hashes of the text (``words.window_hashes``); an
n-gram counts as repeated from its second occurrence in the same text on, and
overlapping repeats count a character once.

Defined cases: a null or empty text has no words and fails the base rule; a
null id stays null; repeated rows give repeated results; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
# Largest share, in percent of word characters, inside repeated n-grams.
MAX_NGRAM_PCT = {5: 25, 7: 23, 10: 20}
# Largest share of word characters in lines equal to an earlier one.
MAX_LINE_CHARS_PCT = 20
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, dup_line_chars bigint, n_repeat_words bigint, "
    "repeat_chars_5 bigint, repeat_chars_7 bigint, repeat_chars_10 bigint, "
    "base_failed boolean, kept boolean"
)
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeats(key: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): windows equal to an earlier one; windows that occur twice or more."""
    later, both = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    later[at[order[1:][equal]]] = True
    both[at[order[:-1][equal]]] = True
    return later, both | later


def _measure(w: W.Words) -> dict[str, np.ndarray]:
    n = len(w)
    text_of = np.repeat(np.arange(len(w.counts)), w.counts).astype(np.uint64)
    chars = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80, dtype=np.int64)])
    width = chars[w.ends] - chars[w.starts]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.raw], dtype=np.int64)])
    out = {
        "n_words": w.counts,
        "word_chars": w.per_text(width),
        "n_symbols": symbols[w.offsets[1:]] - symbols[w.offsets[:-1]],
    }
    h, salt = w.hashes(), W.mix(text_of + np.uint64(1))
    at = np.flatnonzero(W.fits(w, 3))
    _, both = _repeats(W.window_hashes(h, 3)[at] ^ salt[at], at, n)
    out["n_repeat_words"] = w.per_text(W.covered(both, 3))
    for size in MAX_NGRAM_PCT:
        # A repeated n-gram begins with a repeated shorter one.
        at = np.flatnonzero(both & W.fits(w, size))
        later, both = _repeats(W.window_hashes(h, size)[at] ^ salt[at], at, n)
        out[f"repeat_chars_{size}"] = w.per_text(np.where(W.covered(later, size), width, 0))
    return out


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and their word characters."""
    if not text:
        return 0, 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[str] = set()
    again = [x for x in lines if x in seen or seen.add(x)]
    return len(again), sum(len(w) for x in again for w in _WORD.findall(x))


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_WORDS_PCT * m["n_words"])
    bad = 100 * m["dup_line_chars"] > MAX_LINE_CHARS_PCT * m["word_chars"]
    for size, pct in MAX_NGRAM_PCT.items():
        bad |= 100 * m[f"repeat_chars_{size}"] > pct * m["word_chars"]
    return base, ~base & ~bad


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j, w in W.slices(texts):
            m = _measure(w)
            lines = np.array([_lines(x.as_py()) for x in texts.slice(i, j - i)], dtype=np.int64).reshape(-1, 2)
            m["n_dup_lines"], m["dup_line_chars"] = lines.T
            m["base_failed"], m["kept"] = _verdict(m)
            columns = [ids.slice(i, j - i), *(pa.array(m[x]) for x in names[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, coverages and verdict.

    No shuffle: each task measures the documents it reads.
    """
    return documents.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(
        _batches, SCHEMA
    )


def keep(documents: DataFrame) -> DataFrame:
    """The documents that pass, in their own columns.

    The verdict is taken beside the row, so rows with equal ids are judged one
    by one.
    """
    schema = documents.schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [f.name for f in schema.fields].index("text")
        for batch in batches:
            blank = pa.nulls(batch.num_rows, pa.int64())
            pair = pa.RecordBatch.from_arrays([blank, batch.column(at)], names=["doc_id", "text"])
            kept = [x.column("kept") for x in _batches([pair])]
            if kept:
                yield batch.filter(pa.chunked_array(kept).combine_chunks())

    return documents.mapInArrow(judged, schema)
