"""Language of each word and text by a linear-chain conditional random field.

Words of code-switched text are labelled with languages. A word's potential is
a sum of learned weights of its prefixes and suffixes, its character n-grams
and its entry in the learned lexicon (log odds per language); a learned matrix
scores the transition between neighbours. Forward-backward gives the marginal
of each language at each word; a document gets the language with the largest
mean marginal over its words that have a letter.

*Fitting* uses a bounded sample of labelled documents: about ``SAMPLE``
documents for each of the ``LABELS`` most frequent languages, chosen by a hash,
each of at most ``SAMPLE_CHARS`` characters. Their words carry the label of the document; runs of different
languages are joined to code-switched chains, so that transitions are learned.
The weights are those of a conditional likelihood, by AdaGrad.

*Labelling* runs over whole texts, in chains of ``CHAIN`` words that are
labelled side by side, without a shuffle. Potentials of common words are kept
by the worker.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
labels that are null are not learned from; without any label everything is
``und``; null ids, repeated rows and extra columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 400
SAMPLE_CHARS = 20_000
LABELS = 1000
CHAIN = 64
UNKNOWN = "und"
_BUCKETS = 1 << 15
_FEATURES = 24
_ROUNDS = 3
_RATE = 0.2
_RUN = 12
_LEXICON = 50_000
_BATCH = 256
# Words and n-grams that a worker remembers: some 40 MB.
_REMEMBERED = 100_000
_REMEMBERED_GRAMS = 50_000
# New words whose potentials are summed together.
_TOGETHER = 4096
_OUTER = ".,;:!?()[]{}\"'|*&%$#-"


class _Places(dict):
    """Weight row of a feature; remembers the short ones it has met."""

    def __missing__(self, gram: str) -> int:
        at = zlib.crc32(gram.encode()) % _BUCKETS
        if len(self) < _REMEMBERED_GRAMS:
            self[gram] = at
        return at


_place = _Places().__getitem__


def _letters(word: str) -> str:
    """The lower-case letters of a word, all that its potential depends on."""
    core = word.strip(_OUTER).lower()
    return core if core.isalpha() else "".join(filter(str.isalpha, normalize("NFC", core)))


def _features(text: str) -> list[int]:
    """Hashed affixes and character n-grams of the letters of a word."""
    if not text:
        return []
    n = len(text)
    found = [f"<{text[0]}", f"{text[-1]}>", f"<{text[:2]}", f"{text[-2:]}>", f"<{text[:3]}", f"{text[-3:]}>"]
    found += [text[i : i + 2] for i in range(min(n - 1, 10))]
    found += [text[i : i + 3] for i in range(1, min(n - 3, 7))]
    return list(map(_place, found))


@dataclass
class Model:
    """Learned weights. lexicon: log odds of a word per language."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexicon_weight: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def kept(self) -> _Potentials:
        """Potentials that a worker keeps between its tasks."""
        if "_kept" not in self.__dict__:
            self._kept = _Potentials(self)
        return self._kept

    def potential(self, words: list[str]) -> np.ndarray:
        """Score of each language for words of these letters, a row each."""
        found = list(map(_features, words))
        size = np.array(list(map(len, found)))
        at = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(size.sum()))
        score = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            score[some] = np.add.reduceat(self.weights[at], (np.cumsum(size) - size)[some], axis=0)
        known = [i for i in some.tolist() if words[i] in self.lexicon]
        if known:
            score[known] += np.array([self.lexicon[words[i]] for i in known]) * self.lexicon_weight
        return score


class _Potentials(dict):
    """Row of each word met in ``rows``: its potentials, and 1 if it has a letter.

    Words of the first batches are kept, which are the common ones; once
    ``_REMEMBERED`` are, those new in a batch are forgotten after it.
    """

    def __init__(self, model: Model):
        self.model, self.of_letters, self.rows = model, {}, np.zeros((4096, len(model.languages) + 1), np.float32)
        self.new_words, self.new_letters = [], []

    def __missing__(self, word: str) -> int:
        letters = _letters(word)
        at = self.of_letters.get(letters)
        if at is None:
            at = self.of_letters[letters] = len(self.of_letters)
            self.new_letters.append(letters)
        self[word] = at
        self.new_words.append(word)
        return at

    def fill(self) -> None:
        """Rows of all words that are new in a batch, taken together."""
        first = len(self.of_letters) - len(self.new_letters)
        while len(self.rows) < len(self.of_letters):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for lo in range(0, len(self.new_letters), _TOGETHER):
            part = self.new_letters[lo : lo + _TOGETHER]
            rows = self.rows[first + lo : first + lo + len(part)]
            rows[:, :-1] = self.model.potential(part)
            rows[:, -1] = list(map(bool, part))

    def batch_done(self) -> None:
        """Forget what is new if enough is kept."""
        if len(self) > _REMEMBERED:
            for word in self.new_words:
                del self[word]
            # Rows are handed out in order, so the kept ones stay the first.
            for letters in self.new_letters:
                del self.of_letters[letters]
        self.new_words, self.new_letters = [], []


def _marginals(score: np.ndarray, size: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side.

    score is (chain, place, language), size the words of each chain. Returns the
    marginals, the expected transitions of all chains and their log partition.
    """
    n, length, k = score.shape
    move = np.exp(transition)
    local = np.exp(score - score.max(axis=2, keepdims=True))
    local[np.arange(length)[None, :] >= size[:, None]] = 1
    ahead = np.empty_like(local)
    log_z = np.zeros(n)
    inside = np.arange(length)[None, :] < size[:, None]
    ahead[:, 0] = local[:, 0]
    for t in range(length):
        if t:
            ahead[:, t] = (ahead[:, t - 1] @ move) * local[:, t]
        total = ahead[:, t].sum(axis=1, keepdims=True)
        ahead[:, t] /= total
        log_z += np.where(inside[:, t], np.log(total[:, 0]), 0)
    back = np.ones((n, k), dtype=score.dtype)
    marginal = np.empty_like(local)
    pairs = np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        m = ahead[:, t] * back
        marginal[:, t] = m / m.sum(axis=1, keepdims=True)
        if t:
            weighted = local[:, t] * back
            joint = ahead[:, t - 1, :, None] * move[None] * weighted[:, None, :]
            live = inside[:, t]
            pairs += (joint[live] / joint[live].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            before = weighted @ move.T
            before /= before.max(axis=1, keepdims=True)
            back = np.where(live[:, None], before, 1)
    return marginal, pairs, log_z


def _label(score: np.ndarray, size: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals alone, for labelling."""
    n, length, k = score.shape
    move = np.exp(transition).astype(np.float32)
    local = np.exp(score - score.max(axis=2, keepdims=True))
    ahead = np.empty_like(local)
    ahead[:, 0] = local[:, 0]
    for t in range(1, length):
        x = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = x / x.sum(axis=1, keepdims=True)
    back = np.ones((n, k), dtype=np.float32)
    for t in range(length - 1, -1, -1):
        ahead[:, t] *= back
        if t:
            x = (local[:, t] * back) @ move.T
            back = np.where((t < size)[:, None], x / x.max(axis=1, keepdims=True), 1)
    return ahead / ahead.sum(axis=2, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from (text, language) rows; None without any labelled word."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    runs: list[tuple[int, list[str]]] = []
    counts = [Counter() for _ in languages]
    for text, lang in rows:
        k = languages.index(lang)
        words = (text or "").split()
        counts[k].update(filter(None, map(_letters, words)))
        at = 0
        while at < len(words):
            step = 1 + int(rng.geometric(1 / _RUN))
            runs.append((k, words[at : at + step]))
            at += step
    if not runs or not any(counts):
        return None
    k = len(languages)
    totals = np.array([sum(c.values()) for c in counts]) + 1.0
    common = [w for w, n in sum(counts, Counter()).most_common(_LEXICON) if n > 2]
    lexicon = {}
    for w in common:
        rate = (np.array([c[w] for c in counts]) + 0.5) / totals
        lexicon[w] = (np.log(rate) - np.log(rate).mean()).astype(np.float32)
    # Half of the runs stay beside their own neighbour: most text is in one language.
    order = np.arange(len(runs))
    moved = rng.permutation(order[rng.random(len(runs)) < 0.5])
    order[np.sort(moved)] = moved
    words = [w for i in order for w in runs[i][1]]
    label = np.array([runs[i][0] for i in order for _ in runs[i][1]])
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.full((len(distinct), _FEATURES), _BUCKETS, dtype=np.int64)
    odds = np.zeros((len(distinct), k))
    for w, i in distinct.items():
        letters = _letters(w)
        f = _features(letters)
        at[i, : len(f)] = f
        if f and (x := lexicon.get(letters)) is not None:
            odds[i] = x
    ids = np.array([distinct[w] for w in words])
    n_chains = -(-len(ids) // CHAIN)
    ids, label = (np.append(x, np.zeros(n_chains * CHAIN - len(x), dtype=np.int64)).reshape(-1, CHAIN) for x in (ids, label))
    size = np.full(n_chains, CHAIN)
    size[-1] = len(words) - (n_chains - 1) * CHAIN
    weights, squares = np.zeros((_BUCKETS + 1, k)), np.full((_BUCKETS + 1, k), 1e-6)
    transition, squares_t = np.zeros((k, k)), np.full((k, k), 1e-6)
    lexical, squares_l = np.ones(k) * 0.1, np.full(k, 1e-6)
    one_hot = np.eye(k)
    for _ in range(_ROUNDS):
        for part in np.array_split(rng.permutation(n_chains), max(1, n_chains // _BATCH)):
            w, y, m = ids[part], label[part], size[part]
            score = weights[at[w]].sum(axis=2) + odds[w] * lexical
            marginal, pairs, _ = _marginals(score, m, transition)
            live = (np.arange(CHAIN)[None, :] < m[:, None])[..., None]
            miss = (one_hot[y] - marginal) * live
            seen = np.zeros((k, k))
            both = live[:, 1:, 0]
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            flat = at[w].reshape(-1)
            g = np.stack([np.bincount(flat, np.repeat(miss[..., j].reshape(-1), _FEATURES), _BUCKETS + 1) for j in range(k)], axis=1)
            g[_BUCKETS] = 0
            for value, square, grad in (
                (weights, squares, g / len(part)),
                (transition, squares_t, (seen - pairs) / len(part)),
                (lexical, squares_l, (miss * odds[w]).sum(axis=(0, 1)) / len(part)),
            ):
                square += grad * grad
                value += _RATE * grad / np.sqrt(square)
    return Model(languages, weights[:_BUCKETS].astype(np.float32), transition, lexicon, lexical.astype(np.float32))


def label_words(potentials: _Potentials, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the marginals of its words and which of them have a letter.

    Texts are taken together up to about 130,000 words.
    """
    at, k, transition = 0, len(potentials.model.languages), potentials.model.transition
    while at < len(texts):
        lists, n = [], 0
        while at < len(texts) and (n < 1 << 17 or not lists):
            lists.append((texts[at] or "").split())
            n += len(lists[-1])
            at += 1
        sizes = np.array([len(x) for x in lists])
        ids = np.fromiter(map(potentials.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=n)
        potentials.fill()
        flat = potentials.rows[ids]
        potentials.batch_done()
        chains = -(-sizes // CHAIN)
        base = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(n) - np.repeat(base[:-1], sizes)
        first = np.repeat(np.cumsum(chains) - chains, sizes)
        slot = (first + place // CHAIN) * CHAIN + place % CHAIN
        score = np.zeros((int(chains.sum()) * CHAIN, k), dtype=np.float32)
        score[slot] = flat[:, :k]
        length = np.bincount(slot // CHAIN, minlength=int(chains.sum()))
        for lo in range(0, len(length), 1024):
            part = score[lo * CHAIN : (lo + 1024) * CHAIN]
            part[:] = _label(part.reshape(-1, CHAIN, k), length[lo : lo + 1024], transition).reshape(-1, k)
        marginal = score[slot]
        for a, b in zip(base[:-1], base[1:]):
            yield marginal[a:b], flat[a:b, k] > 0


def _judge(potentials: _Potentials | None, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and the runs of words of one language, per text."""
    if potentials is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    names, scores, runs = [], [], []
    model = potentials.model
    for marginal, lettered in label_words(potentials, texts):
        if not lettered.any():
            names.append(UNKNOWN), scores.append(0.0), runs.append([])
            continue
        mean = marginal[lettered].mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        names.append(model.languages[best])
        scores.append(min(1.0, float(mean[best])))
        place = np.flatnonzero(lettered)
        top = marginal[place].argmax(axis=1)
        heads = np.flatnonzero(np.diff(top, prepend=-1))
        ends = np.append(place[heads[1:]], len(marginal))
        runs.append([{"lang": model.languages[top[h]], "from": int(place[h]), "to": int(e)} for h, e in zip(heads, ends)])
    return names, scores, runs


# Rows that are judged together; their words are taken in smaller parts.
_ROWS = 2000
_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))


def _predict(shared, extra: list[str], runs_too: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = shared.value.kept() if shared.value else None
        for part in (b.slice(lo, _ROWS) for b in batches for lo in range(0, b.num_rows, _ROWS)):
            names, scores, runs = _judge(potentials, part.column("text").to_pylist())
            columns = [part.column(c) for c in extra] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if runs_too:
                columns.append(pa.array(runs, _RUNS))
            yield pa.RecordBatch.from_arrays(columns, names=[*extra, "lang_pred", "score", "runs"][: len(columns)])

    return run


def sample(labelled: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most about ``per_language`` documents a language, chosen by a hash of the id.

    The share of each language comes from its count, so nothing is sorted or
    gathered by language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length("text") <= chars))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()
    if not counts:
        return usable.limit(0).select("text", "lang")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in counts], F.lit(0.0))
    return usable.filter(draw < share).select("text", "lang").limit(2 * per_language * len(counts))


def train(labelled: DataFrame) -> Model | None:
    """A model from the (doc_id, text, lang) rows of ``labelled``."""
    rows = sample(labelled.select("doc_id", "text", "lang")).collect()
    return fit(sorted((r.text, r.lang) for r in rows))


def identify(documents: DataFrame, model: Model | None, keep: list[str], runs: bool = False) -> DataFrame:
    """The columns ``keep`` and lang_pred, score; with ``runs`` also the labelled runs of words."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rest = documents.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*keep).schema)
    more = ", runs array<struct<lang:string,`from`:int,`to`:int>>" if runs else ""
    return rest.mapInArrow(_predict(shared, keep, runs), f"{kinds}, lang_pred string, score double{more}")


def keep(documents: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The documents in a language that the model knows well enough, in their own columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = shared.value.kept() if shared.value else None
        at = schema.names.index("text")
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                names, scores, _ = _judge(potentials, part.column(at).to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores)]))

    return documents.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the id's checksum puts a document into the part that is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
