"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a public SentencePiece model file. A
text gets a marker in front and for every space; the segmentation with the
highest sum of scores is found by Viterbi, a character without a piece costs
``UNKNOWN_COST`` below the worst score and becomes its bytes' pieces. Ties go to
the longer last piece, as in the library's own search.

No piece has a marker behind another character, so the best segmentation of a
text is that of its words one after the other. Viterbi runs over the distinct
words that a task has not met yet, all words of a length side by side: one step
follows the trie from the same byte of every word.

Decoding joins the pieces, turns markers to spaces and drops the first one; runs
of byte pieces are read as UTF-8, with U+FFFD for what is not.

Defined cases: a null or empty text has no ids and decodes to an empty text; a
text with the marker character itself decodes to a space there; null ids and
repeated rows pass; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARKER = "▁"
UNKNOWN_COST = 10.0
REMEMBERED = 100_000
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+$")
_SLICE = 1 << 20
_CELLS = 1 << 20


class DoubleArray:
    """base, check and the piece id that ends at a node (-1: none).

    The child of node s by byte c is base[s] + c where check[base[s] + c] is s.
    """

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = value
        size = len(tree) * 2 + 512
        base, check = [0] * size, [-1] * size
        check[0] = 0
        place, hint, order = {0: 0}, 1, [0]
        for at in order:
            labels = sorted(tree[at])
            if not labels:
                continue
            spot, tries = max(hint, labels[0] + 1), 0
            while True:
                if spot + 512 >= len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                b = spot - labels[0]
                if check[spot] == -1 and all(check[b + c] == -1 for c in labels):
                    break
                spot, tries = spot + 1, tries + 1
            # Where it is crowded, later nodes look further on.
            hint = spot if tries > 64 else hint
            s = place[at]
            base[s] = b
            for c in labels:
                check[b + c] = s
                place[tree[at][c]] = b + c
                order.append(tree[at][c])
        self.base, self.check = np.array(base, dtype=np.int32), np.array(check, dtype=np.int32)
        used = max(place.values()) + 257
        self.base, self.check = self.base[:used], self.check[:used]
        self.piece = np.full(used, -1, dtype=np.int32)
        for at, value in ends.items():
            self.piece[place[at]] = value
        self.check[0] = -1


class Vocabulary:
    """Pieces, scores and the trie of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i)]
        bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        out = {*special, *bytes_.values(), *(i for i in range(n) if model.is_unused(i))}
        self.scores = np.array([model.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if i not in out]
        self.worst = float(self.scores[normal].min()) - UNKNOWN_COST
        self.trie = DoubleArray({pieces[i].encode(): i for i in normal})
        self.byte_id = np.array([bytes_.get(c, model.unk_id()) for c in range(256)], dtype=np.int32)
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[list(bytes_.values())] = True
        self.text = [b"" if i in special else p.encode() for i, p in enumerate(pieces)]
        for c, i in bytes_.items():
            self.text[i] = bytes([c])
        self.known: dict[str, tuple[bytes, float]] = {}

    def viterbi(self, words: list[bytes]) -> list[tuple[bytes, float]]:
        """(ids as bytes of 32-bit integers, score) of words of one length."""
        n, length = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(n, length)
        head = (raw & 0xC0) != 0x80
        width = np.where(raw < 0xC0, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, length + 1), dtype=np.int32), np.full((n, length + 1), -1, dtype=np.int32)
        base, check, ends = self.trie.base, self.trie.check, self.trie.piece
        for s in range(length):
            rows = np.flatnonzero(head[:, s])
            node, single = np.zeros(len(rows), dtype=np.int32), np.zeros(n, dtype=bool)
            for e in range(s + 1, length + 1):
                nxt = base[node] + raw[rows, e - 1]
                ok = check[nxt] == node
                rows, node = rows[ok], nxt[ok]
                if not len(rows):
                    break
                hit = ends[node] >= 0
                if hit.any():
                    r, found = rows[hit], ends[node[hit]]
                    single[r[width[r, s] == e - s]] = True
                    value = best[r, s] + self.scores[found]
                    up = value > best[r, e]
                    r, found, value = r[up], found[up], value[up]
                    best[r, e], start[r, e], piece[r, e] = value, s, found
            rows = np.flatnonzero(head[:, s] & ~single)
            e = s + width[rows, s]
            value = best[rows, s] + self.worst
            up = value > best[rows, e]
            rows, e, value = rows[up], e[up], value[up]
            best[rows, e], start[rows, e], piece[rows, e] = value, s, -1
        ids = np.full((n, length), -1, dtype=np.int32)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            here, before = piece[rows, at], start[rows, at]
            known = here >= 0
            ids[rows[known], before[known]] = here[known]
            lone, lo, hi = rows[~known], before[~known], at[~known]
            for k in range(4):
                more = lo + k < hi
                ids[lone[more], lo[more] + k] = self.byte_id[raw[lone[more], lo[more] + k]]
            rows, at = rows[before > 0], before[before > 0]
        size = (ids >= 0).sum(axis=1)
        flat, edge = ids[ids >= 0].astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(size)]) * 4
        return [(flat[a:b], float(x)) for a, b, x in zip(edge[:-1], edge[1:], best[:, length])]

    def learn(self, words: set[str]) -> None:
        """Segment the words, those of a length side by side."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w.encode()), []).append(w)
        for length, group in by_length.items():
            step = max(1, _CELLS // length)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                self.known.update(zip(part, self.viterbi([w.encode() for w in part])))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, float]]:
        """(ids as bytes of 32-bit integers, score) of each text."""
        split = [_WORD.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new: set[str] = set()
        for words in split:
            new.update(w for w in words if w not in known)
        self.learn(new)
        out = []
        for words in split:
            found = [known[w] for w in words]
            out.append((b"".join([x[0] for x in found]), sum(x[1] for x in found)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids."""
        text = b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")
        return text.replace(MARKER, " ").removeprefix(" ")


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary that a worker keeps between its tasks."""
    return Vocabulary(path)


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    at, part, size = 0, [], 0
    for text in texts.to_pylist():
        part.append(text)
        size += len(text or "")
        if size >= _SLICE:
            yield at, part
            at, part, size = at + len(part), [], 0
    if part:
        yield at, part


def _encoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at, part in _parts(batch.column("text")):
                ids = v.encode(part)
                flat = np.frombuffer(b"".join(x[0] for x in ids), dtype="<i4")
                size = np.array([len(x[0]) // 4 for x in ids])
                edge = np.concatenate([[0], np.cumsum(size)])
                in_bytes = np.concatenate([[0], np.cumsum(v.is_byte[flat])])
                back = [v.decode(flat[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:])]
                columns = [
                    batch.column("doc_id")[at : at + len(part)],
                    pa.array(size.astype(np.int64)),
                    pa.array((in_bytes[edge[1:]] - in_bytes[edge[:-1]]).astype(np.int64)),
                    pa.array([x[1] for x in ids], pa.float64()),
                    pa.array([zlib.crc32(x[0]) for x in ids], pa.int64()),
                    pa.array([a == (b or "") for a, b in zip(back, part)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_ids", "n_byte_ids", "log_score", "ids_crc32", "round_trip", "ids"]
                )

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, log_score, ids_crc32, round_trip, ids) of every document.

    ``round_trip`` says whether the ids decode to the text.
    """
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        _encoded(path),
        "doc_id bigint, n_ids bigint, n_byte_ids bigint, log_score double, ids_crc32 bigint, "
        "round_trip boolean, ids array<int>",
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
