"""All keywords of a list in one pass over Arrow's text buffer.

An Aho-Corasick automaton over UTF-8 bytes, as one dense table of transitions.
Texts are cut into pieces of a fixed length that overlap by the longest keyword,
and numpy advances the state of all pieces by one byte at a time. A byte costs
one look-up, however many keywords there are and however long its text is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Bytes of a piece, and pieces that are advanced together.
PIECE, LANES = 256, 16_384
# Bytes of the texts that are worked on at a time: a batch may hold many times more.
SLICE = 1 << 22


class Automaton:
    """Which groups of keywords occur in texts."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        self.groups = len(groups)
        keys: dict[bytes, set[int]] = {}
        for number, words in enumerate(groups):
            for word in words:
                keys.setdefault(word.encode(), set()).add(number)
        # An empty keyword occurs everywhere.
        self.always = np.array(sorted(keys.pop(b"", ())), dtype=np.int64)
        self.longest = max(map(len, keys), default=0)
        used = sorted({b for key in keys for b in key})
        self.kind = np.zeros(256, dtype=np.uint8)
        self.kind[used] = np.arange(1, len(used) + 1)
        self._build(keys, len(used) + 1)

    def _build(self, keys: dict[bytes, set[int]], kinds: int) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for key, numbers in keys.items():
            at = 0
            for kind in self.kind[list(key)].tolist():
                if kind not in children[at]:
                    children[at][kind] = len(children)
                    children.append({})
                    ends.append(set())
                at = children[at][kind]
            ends[at] |= numbers
        step = np.zeros((len(children), kinds), dtype=np.int64)
        back = [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            ends[at] |= ends[back[at]]
            step[at] = step[back[at]] if at else 0
            for kind, child in children[at].items():
                back[child] = int(step[at, kind]) if at else 0
                step[at, kind] = child
                queue.append(child)
        # States that end a keyword get the highest numbers, so one comparison finds them.
        order = np.array(sorted(range(len(children)), key=lambda s: (bool(ends[s]), s)))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.table = (place[step[order]] * kinds).astype(np.intp).ravel()
        self.root = int(place[0]) * kinds
        ending = [s for s in order.tolist() if ends[s]]
        self.first_end, self.kinds = (len(order) - len(ending)) * kinds, kinds
        self.found = np.zeros((len(ending), -(-self.groups // 64)), dtype=np.uint64)
        for row, state in zip(self.found, ending):
            for number in ends[state]:
                row[number // 64] |= np.uint64(1 << number % 64)

    def hits(self, texts: pa.Array) -> np.ndarray:
        """A row of bits for each text; null texts have none."""
        texts = texts.cast(pa.large_string())
        rows = len(texts)
        bits = np.zeros((rows, self.found.shape[1]), dtype=np.uint64)
        for number in self.always.tolist():
            bits[:, number // 64] |= np.uint64(1 << number % 64)
        if not rows or not self.longest or texts.buffers()[2] is None:
            return bits
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        reach = PIECE + self.longest - 1
        data = np.zeros(high - low + reach, dtype=np.uint8)
        data[: high - low] = self.kind[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high]]
        begin, size = offsets[:-1] - low, np.diff(offsets)
        if texts.null_count:
            size = np.where(texts.is_valid().to_numpy(zero_copy_only=False), size, 0)
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(rows), pieces)
        start = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(begin[text] + size[text] - start, reach)
        order = np.argsort(-length, kind="stable")
        windows = np.lib.stride_tricks.sliding_window_view(data, reach)
        for lo in range(0, len(order), LANES):
            part = order[lo : lo + LANES]
            self._advance(windows[start[part]], length[part], text[part], bits)
        return bits

    def _advance(self, lanes: np.ndarray, length: np.ndarray, text: np.ndarray, bits: np.ndarray) -> None:
        """Run pieces, longest first, to their ends and add what they hold."""
        lanes = np.ascontiguousarray(lanes.T)
        state = np.full(len(length), self.root, dtype=np.intp)
        seen = np.zeros((len(length), bits.shape[1]), dtype=np.uint64)
        live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for kinds, n in zip(lanes, live.tolist()):
            now = state[:n]
            now += kinds[:n]
            np.take(self.table, now, out=now, mode="clip")
            at = np.flatnonzero(now >= self.first_end)
            if len(at):
                seen[at] |= self.found[(now[at] - self.first_end) // self.kinds]
        for i in range(bits.shape[1]):
            np.bitwise_or.at(bits[:, i], text, seen[:, i])

    def numbers(self, texts: pa.Array) -> pa.Array:
        """Ascending numbers of the groups found in each text; null for null."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self._numbers(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])

    def _numbers(self, texts: pa.Array) -> pa.Array:
        bits = self.hits(texts)
        if not len(bits):
            return pa.array([], pa.list_(pa.int32()))
        flags = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
        row, number = np.nonzero(flags)
        at = np.searchsorted(row, np.arange(len(bits) + 1)).astype(np.int32)
        absent = None if not texts.null_count else pa.array(~texts.is_valid().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(at), pa.array(number.astype(np.int32)), mask=absent)


def found_groups(text: Column, groups: Sequence[Sequence[str]], *, once: bool = False) -> Column:
    """Ascending numbers of the groups with a keyword in the text; NULL for NULL.

    Meant for long texts; a few tests on short names are cheaper by
    ``matching.contains_any``. Not for use inside a function of array elements.
    With ``once`` a filter on the result reads it; otherwise the optimizer moves the
    filter below and searches every text a second time, by a second worker.
    """
    machine = Automaton(groups)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return machine.numbers(texts)

    return (run.asNondeterministic() if once else run)(text)
