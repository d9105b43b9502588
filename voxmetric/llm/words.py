"""Words of a batch of texts as numpy arrays, hashed without a Python loop.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; no word spans two texts. Arrow's own text buffer is
read in place. Texts are taken in slices of whole documents of about
``SLICE_BYTES``, so memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
LONG_WORD = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U64 = np.uint64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U64)
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambler: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than texts) and bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return at - at[0], raw


class Words:
    """Word positions of the texts of one slice.

    starts, ends: byte range of each word in ``raw``; first: index of the first
    word of each text (one more than texts); last: for each word, the index
    after the last word of its text.
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        self.offsets, self.raw = offsets, raw
        inside = ~_SPACE[raw]
        begin, end = inside.copy(), inside.copy()
        if len(raw):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            begin[heads] = inside[heads]
            end[heads[1:] - 1] = inside[heads[1:] - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.last = np.repeat(self.first[1:], self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.ends - self.starts
        padded = np.zeros(len(self.raw) + 8, dtype=np.uint8)
        padded[: len(self.raw)] = self.raw
        eights = np.ndarray((len(self.raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        salt = _U64((seed * _BASE + 0x632BE59BD9B4E019) & _ALL)
        h = mix((eights[self.starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(_U64) * _U64(_BASE) + salt))
        rest = np.flatnonzero(size > 8)
        long_ones = rest[size[rest] > LONG_WORD]
        rest, done = rest[size[rest] <= LONG_WORD], 8
        while len(rest):
            left = size[rest] - done
            part = eights[self.starts[rest] + done] & _MASKS[np.minimum(left, 8)]
            h[rest] = mix((h[rest] * _U64(_BASE)) ^ part)
            rest, done = rest[left > 8], done + 8
        for i in long_ones:
            h[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]].tobytes(), seed)
        return h

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a word column by text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, by doubling.

    As long as ``h``; the last n - 1 entries and those that run past the end of
    their text mean nothing, see ``fits``.
    """
    out, width, power = None, 0, _BASE
    part, size, base = h.copy(), 1, _BASE
    left = n
    while left:
        if left & 1:
            if out is None:
                out, width, power = part.copy(), size, base
            else:
                out = out + _ahead(part, width) * _U64(power)
                width, power = width + size, power * base & _ALL
        left >>= 1
        if left:
            part = part + _ahead(part, size) * _U64(base)
            size, base = size * 2, base * base & _ALL
    return mix(out)


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def fits(words: Words, n: int) -> np.ndarray:
    """Whether the window of n words from each position ends in the same text."""
    return np.arange(len(words)) + n <= words.last


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside a window of n words that begins where ``starts`` is true."""
    total = np.cumsum(starts, dtype=np.int64)
    total[n:] -= total[:-n].copy() if n < len(total) else 0
    return total > 0


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, Words) for slices of whole texts."""
    offsets, raw = text_buffer(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, Words(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]])
        i = j
