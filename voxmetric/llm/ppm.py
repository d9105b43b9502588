"""Language-model scores of documents: unigram base and prediction by partial matching.

*Text.* A-Z lower-cased; words joined by one space, then one end symbol. Its
tokens are the words and the end.

*Base.* Token counts are summed over all training documents. Words with at least
one in ``COMMON`` of all training tokens (at most ``COMMON`` words, whatever the
corpus) are looked up in the task; the others are joined by word.

*PPM.* The counts of all ``ORDER + 1``-symbol strings of the training texts are
summed by Spark, and from them those of all shorter ones: the byte-context trie,
with every context of the training texts. It is a written table and grows with
the corpus. From the deepest context on, a symbol is coded with its count over
total plus distinct symbols, or escapes to the next shorter context with the
distinct symbols as the escape's count (method C); symbols that a longer context
has seen are excluded from the shorter ones; last comes a uniform choice among
the symbols never seen. A document's score is the sum over its symbols, the end
included.

*Costs.* What a symbol costs depends on its string of ``ORDER + 1`` symbols only.
A shorter context has seen whatever a longer one has, so what is excluded is
known from the step before, and costs are worked out by joins from the shortest
strings to the longest. A key of these joins has at most 257 rows. The costs of
the commonest strings (at most ``STRINGS``, whatever the corpus) are looked up in
the task; a document's other strings are counted, written and joined.

Defined cases: a null text is empty and scores its end; without training
documents every symbol is uniform and the base counts are zero; repeated rows
are scored, and learned, as often as they come; a null id is a training row; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

ORDER = 5
STRINGS = 1 << 21
COMMON = 1 << 17
END = 256
_SYMBOLS = 257
_BITS = 9
_SLICE = 1 << 20
_HELD = 400_000


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether the id's checksum puts a document into the part that is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one after the other, each closed by END; the place after each end."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw[ends - 1] = END
    return raw, ends


def _strings(raw: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """For each place the code of its symbol and the ``order`` symbols before it.

    The newest symbol is in the lowest bits. Before a text there are END symbols.
    """
    start = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    at = np.arange(len(raw)) - start
    code = raw.copy()
    for j in range(1, order + 1):
        before = np.empty_like(raw)
        before[j:] = raw[:-j]
        before[at < j] = END
        code |= before << (_BITS * j)
    return code


def _grouped(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for text in texts:
        words = _tokens(text)
        part.append(words)
        size += len(text or "")
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(made, names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            held.update(_tokens(text.as_py()))
            if len(held) > _HELD:
                yield out()
    if held:
        yield out()


def _count_strings(order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in _grouped(batch.column("text").to_pylist()):
                new, n = np.unique(_strings(*_symbols([b" ".join(w) for w in part]), order), return_counts=True)
                codes, counts = np.append(codes, new), np.append(counts, n)
                if len(codes) > 4 * _HELD:
                    codes, counts = _merged(codes, counts)
                    if len(codes) > 2 * _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                        codes, counts = codes[:0], counts[:0]
        codes, counts = _merged(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return run


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _ends(code: str, order: int) -> Column:
    """(depth, code) of the strings of 1 to ``order + 1`` symbols that end like ``code``."""
    return F.array(
        *[
            F.struct(F.lit(d).alias("depth"), F.col(code).bitwiseAND(F.lit((1 << (_BITS * (d + 1))) - 1)).alias("code"))
            for d in range(order + 1)
        ]
    )


def _last(column: str, symbols: str) -> Column:
    """The last so many symbols of a string."""
    return F.expr(f"{column} & (shiftleft(1L, {_BITS} * ({symbols})) - 1)")


def strings(training: DataFrame, order: int = ORDER) -> DataFrame:
    """(depth, code, n): how often each symbol follows each context of ``depth`` symbols."""
    longest = training.select("text").mapInArrow(_count_strings(order), "code bigint, n bigint")
    longest = longest.groupBy("code").agg(F.sum("n").alias("n"))
    each = longest.select("n", F.inline(_ends("code", order)))
    return written(each.groupBy("depth", "code").agg(F.sum("n").alias("n")), "strings")


def escapes(counted: DataFrame) -> DataFrame:
    """Every context of the trie, a row each.

    Columns: depth, context, total, kinds; what the symbols that it has not seen
    share in the context one shorter, with that one's escape (whole_up), and the
    log10 probability of a further escape there (out_up).
    """
    above = counted.select((F.col("depth") + 1).alias("depth"), F.col("code").alias("up"), F.col("n").alias("n_up"))
    seen = counted.withColumn("up", _last("code", "depth")).join(above, ["depth", "up"], "left")
    grouped = seen.groupBy("depth", F.shiftright("code", _BITS).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n_up").alias("covered")
    )
    grouped = written(grouped, "totals")
    above = grouped.select(
        (F.col("depth") + 1).alias("depth"), F.col("context").alias("up"), F.col("total").alias("total_up"), F.col("kinds").alias("kinds_up")
    )
    escape = F.when(F.col("kinds_up") < _SYMBOLS, F.col("kinds_up") - F.col("kinds")).otherwise(F.lit(0))
    joined = grouped.withColumn("up", _last("context", "greatest(depth - 1, 0)")).join(above, ["depth", "up"], "left")
    whole = F.col("total_up") - F.col("covered") + escape
    # Nothing new in the shorter context: the walk goes through it without a choice.
    out = F.when(escape > 0, F.log10(escape) - F.log10(whole)).otherwise(F.lit(0.0))
    return written(joined.select("depth", "context", "total", "kinds", whole.alias("whole_up"), out.alias("out_up")), "contexts")


def costs(codes: DataFrame, counted: DataFrame, trie: DataFrame, order: int, most: int | None = None) -> DataFrame:
    """(code, cost): log10 probability of the last symbol of each string after the others.

    With ``most``, contexts with less than one in ``most`` of all symbols are not in the trie.
    """
    every = codes.select(F.inline(_ends("code", order))).distinct()
    every = every.join(counted, ["depth", "code"], "left").withColumn("context", F.shiftright("code", _BITS))
    every = written(every.join(trie, ["depth", "context"], "left").withColumn("up", _last("code", "depth")), "levels")
    inside = F.col("total").isNotNull()
    if most is not None:
        everything = trie.filter("depth = 0").agg(F.sum("total")).first()[0] or 0
        inside &= F.col("total") * most >= F.lit(everything)
    leave = F.when(F.col("kinds") < _SYMBOLS, F.log10("kinds") - F.log10(F.col("total") + F.col("kinds")))
    stay = F.log10("n") - F.log10(F.col("total") + F.col("kinds"))
    nothing, below = F.lit(-float(np.log10(_SYMBOLS))), None
    for depth in range(order + 1):
        here = every.filter(F.col("depth") == depth).drop("depth", "context")
        if below is None:
            # After leaving a context, and at the context.
            left, shorter = -F.log10(F.lit(_SYMBOLS) - F.col("kinds")), nothing
        else:
            here = here.join(below, "up")
            left = F.when(F.col("n_below").isNotNull(), F.log10("n_below") - F.log10("whole_up"))
            left, shorter = left.otherwise(F.col("out_up") + F.col("left_below")), F.col("cost_below")
        cost = F.when(~inside, shorter).when(F.col("n").isNotNull(), stay).otherwise(leave + left)
        below = here.select(
            F.col("code").alias("up"), F.col("n").alias("n_below"), left.alias("left_below"), cost.alias("cost_below")
        )
    return below.select(F.col("up").alias("code"), F.col("cost_below").alias("cost"))


def contexts(training: DataFrame, order: int = ORDER, most: int = 1 << 14) -> list:
    """(depth, context, symbols, counts) of the contexts with one in ``most`` of all symbols."""
    grouped = strings(training, order).groupBy("depth", F.shiftright("code", _BITS).alias("context")).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct(F.col("code").bitwiseAND(F.lit(511)).alias("symbol"), "n")).alias("seen")
    )
    total = written(grouped, "contexts")
    everything = total.filter("depth = 0").agg(F.sum("total")).first()[0] or 0
    rows = total.filter((F.col("total") * most >= F.lit(everything)) & (F.col("total") > 0))
    return rows.select("depth", "context", "seen.symbol", "seen.n").collect()


class Trie:
    """A small trie as tables, for comparison: ``child`` by (node, symbol before), ``cost`` by (node, next symbol)."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        if not rows:
            rows = [(0, 0, [], [])]
        self.node = {(r[0], r[1]): i for i, r in enumerate(rows)}
        self.rows = rows

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """child, and log10 probabilities, which are worked out by one walk per context."""
        n = len(self.rows)
        counts = np.zeros((n, _SYMBOLS), dtype=np.float64)
        parent, child = np.full(n, -1), np.full((n, _SYMBOLS), -1, dtype=np.int32)
        for i, (depth, context, symbols, times) in enumerate(self.rows):
            counts[i, symbols] = times
            if depth:
                last = context >> (_BITS * (depth - 1))
                parent[i] = self.node[depth - 1, context & ((1 << (_BITS * (depth - 1))) - 1)]
                child[parent[i], last] = i
        cost = np.empty((n, _SYMBOLS), dtype=np.float32)
        for lo in range(0, n, 512):
            at = np.arange(lo, min(lo + 512, n))
            excluded, mass = np.zeros((len(at), _SYMBOLS), dtype=bool), np.ones((len(at), 1))
            share = np.zeros((len(at), _SYMBOLS))
            while (at >= 0).any():
                seen = np.where((at >= 0)[:, None] & ~excluded, counts[at], 0)
                kinds = (seen > 0).sum(axis=1, keepdims=True)
                new = excluded | (seen > 0)
                escape = np.where(new.all(axis=1, keepdims=True), 0, kinds)
                whole = np.maximum(seen.sum(axis=1, keepdims=True) + escape, 1)
                share += mass * seen / whole
                mass = np.where(kinds > 0, mass * escape / whole, mass)
                excluded, at = new, np.where(at >= 0, parent[at], -1)
            rest = np.maximum((~excluded).sum(axis=1, keepdims=True), 1)
            share += np.where(excluded, 0, mass / rest)
            cost[lo : lo + 512] = np.log10(share)
        return child, cost


def _score(codes: np.ndarray, cost: np.ndarray, order: int, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """log10 probability of each text and its end by the costs of sorted ``codes``, and counts of its other strings."""
    raw, ends = _symbols(texts)
    size = np.diff(np.concatenate([[0], ends]))
    distinct, which = np.unique(_strings(raw, ends, order), return_inverse=True)
    at = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
    known = codes[at] == distinct if len(codes) else np.zeros(len(distinct), dtype=bool)
    each = np.zeros(len(distinct))
    each[known] = cost[at[known]]
    total = np.concatenate([[0.0], np.cumsum(each[which])])
    other = ~known[which]
    text = np.repeat(np.arange(len(texts)), size)[other]
    pairs, times = np.unique(text * len(distinct) + which[other], return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(distinct))
    found = pa.StructArray.from_arrays([pa.array(distinct[pairs % len(distinct)]), pa.array(times.astype(np.int64))], names=["code", "n"])
    return total[ends] - total[ends - size], pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)


def _scored(common, costly, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (codes, cost) = common.value, costly.value
        for batch in batches:
            at = 0
            for part in _grouped(batch.column("text").to_pylist()):
                n_tokens, n_known, logs, rare = [], [], [], []
                for words in part:
                    found = [known.get(w) for w in words]
                    tail = Counter(w for w, x in zip(words, found) if x is None)
                    here = [x for x in found if x is not None]
                    n_tokens.append(len(words) + 1)
                    n_known.append(len(here))
                    logs.append(sum(here))
                    rare.append([{"word": w, "n": n} for w, n in tail.items()])
                score, strange = _score(codes, cost, order, [b" ".join(w) for w in part])
                rows = slice(at, at + len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows], batch.column("held_out")[rows],
                        pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()),
                        pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                        pa.array(score, pa.float64()), strange,
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_common", "log_common", "rare", "log_strings", "strange"],
                )

    return run


def _commonest(counted: DataFrame, trie: DataFrame, order: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and costs of the commonest strings, at most ``STRINGS``."""
    longest = counted.filter(F.col("depth") == order)
    power = F.length(F.bin("n"))
    least, size = 64, 0
    for at, n in sorted(longest.groupBy(power.alias("power")).agg(F.count(F.lit(1))).collect(), reverse=True):
        size += n
        if size > STRINGS:
            break
        least = at
    found = costs(longest.filter(power >= least).select("code"), counted, trie, order, most).toArrow()
    codes, cost = found["code"].to_numpy(), found["cost"].to_numpy().astype(np.float32)
    sort = np.argsort(codes)
    return codes[sort], cost[sort]


def score(documents: DataFrame, order: int = ORDER, most: int | None = None) -> DataFrame:
    """Scores of every document; ``held_out`` says which are not learned from.

    All contexts are in the trie unless ``most`` is given, see ``costs``.
    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = documents.sparkSession
    documents = documents.selectExpr("cast(doc_id as bigint) doc_id", "held_out", "text")
    training = documents.filter(~F.col("held_out"))
    words = training.select("text").mapInArrow(_count_words, "word binary, n bigint")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    frequent = F.col("n") * COMMON >= F.lit(total)
    common = {bytes(w): float(np.log10(n + 1)) for w, n in words.filter(frequent & (F.length("word") <= 64)).collect()}
    counted = strings(training, order)
    trie = escapes(counted)
    sent = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(_commonest(counted, trie, order, most))
    found = documents.mapInArrow(
        _scored(*sent, order),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_common bigint, log_common double, "
        "rare array<struct<word:binary,n:bigint>>, log_strings double, strange array<struct<code:bigint,n:bigint>>",
    )
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = found.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    tail = (
        rare.join(words.filter(~(frequent & (F.length("word") <= 64))), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_rare"))
    )
    strange = found.select("row", F.inline("strange"))
    costly = written(costs(strange.select("code").distinct(), counted, trie, order, most), "costs")
    # One row a string on that side, so that a string of many documents is split.
    others = strange.join(costly, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("log_strange"))
    base = (
        F.col("log_common") + F.coalesce("log_rare", F.lit(0.0)) + F.log10(F.lit(ends + 1.0))
        - F.col("n_tokens") * F.log10(F.lit(total + distinct + 1.0))
    )
    return found.drop("rare", "strange").join(tail, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (F.col("log_strings") + F.coalesce("log_strange", F.lit(0.0))).alias("score"),
    )
