"""Repetition rules, pieces, language labels, scores: one row in, one row out."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import clashing, documents, odd_rows, prose, rows_of
from pyspark.sql import functions as F

from voxmetric.llm import crf, ppm, repetition, unigram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------- repetition


def repetition_by_hand(text):
    text = text or ""
    w = WORD.findall(text)

    def inside(n, first):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        times, seen, found = collections.Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if g in seen or (first and times[g] > 1):
                found.update(range(i, i + n))
            seen.add(g)
        return found

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, w))
    repeated = {n: sum(len(w[i]) for i in inside(n, False)) for n in (5, 7, 10)}
    line_chars = sum(len(x) for line in again for x in WORD.findall(line))
    words = len(inside(3, True))
    failed = len(w) < 50 or 100 * words > 50 * len(w)
    bad = 100 * line_chars > 20 * chars or any(100 * repeated[n] > p * chars for n, p in ((5, 25), (7, 23), (10, 20)))
    return (
        len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), words, *repeated.values(), failed, not failed and not bad,
    )


COLUMNS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words repeat_chars_5 repeat_chars_7 repeat_chars_10 base_failed kept"
).split()


def test_repetition_against_brute_force(spark):
    rows = odd_rows() + [(20 + s, prose(s, 40 + 5 * s) + prose(s % 7, 30)) for s in range(30)]
    got = rows_of(repetition.measure(documents(spark, rows)), "doc_id", *COLUMNS)
    assert got == sorted(((i, *repetition_by_hand(t)) for i, t in rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_repetition_ignores_other_columns_and_keeps_rows(spark):
    df = documents(spark, odd_rows())
    assert rows_of(repetition.measure(clashing(df)), "doc_id", *COLUMNS) == rows_of(repetition.measure(df), "doc_id", *COLUMNS)
    kept = repetition.keep(clashing(df))
    assert kept.columns == clashing(df).columns
    want = sorted(((i, t) for i, t in odd_rows() if repetition_by_hand(t)[-1]), key=repr)
    assert rows_of(kept, "doc_id", "text") == want
    assert repetition.measure(df.limit(0)).count() == 0 == repetition.keep(df.limit(0)).count()


# ----------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.vocabulary(PIECES)


def ids_of(vocabulary, text):
    return np.frombuffer(vocabulary.encode([text])[0][0], "<i4").tolist()


def test_pieces_are_the_best_of_the_library(vocabulary):
    # The same model with its type set to unigram: the last trainer settings win.
    # Its n-best search is exact; its plain one takes a word that is a piece as it is.
    raw = open(PIECES, "rb").read() + b"\x12\x02\x18\x01"
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for seed in range(300):
        text = " ".join(prose(seed, 1 + seed % 12).split())
        ids, best = ids_of(vocabulary, text), library.nbest_encode_as_ids(text, 2)[0]
        if vocabulary.scores[ids].min() > -1e6:  # beyond, the library's 32-bit sums lose the rest
            assert ids == best or vocabulary.scores[ids].sum() == vocabulary.scores[best].sum(), text
        assert vocabulary.decode(ids) == text == library.decode(best)


def test_pieces_against_plain_viterbi(vocabulary):
    pieces = {t: i for i, t in enumerate(vocabulary.text) if t and not vocabulary.is_byte[i]}
    for seed in range(40):
        text = prose(seed, 4)
        marked = "▁" + text.replace(" ", "▁")
        best = [(0.0, [])] + [(-math.inf, [])] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - 48), end):
                i = pieces.get(marked[start:end].encode())
                score = vocabulary.scores[i] if i is not None else vocabulary.worst if end == start + 1 else -math.inf
                if best[start][0] + score > best[end][0]:
                    tail = [i] if i is not None else [int(vocabulary.byte_id[c]) for c in marked[start:end].encode()]
                    best[end] = best[start][0] + score, best[start][1] + tail
        ids, score = vocabulary.encode([text])[0]
        assert np.frombuffer(ids, "<i4").tolist() == best[-1][1] and score == pytest.approx(best[-1][0])


def test_pieces_of_odd_rows(spark):
    df = documents(spark, odd_rows())
    encoded = unigram.encode(clashing(df), PIECES).cache()
    got = {(r.doc_id, r.n_ids, r.round_trip) for r in encoded.collect()}
    assert {(1, 0, True), (2, 0, True)} <= got
    assert sorted(r.round_trip for r in encoded.collect()) == [False] + [True] * 15  # the marker itself
    back = rows_of(unigram.decode(encoded, PIECES), "doc_id", "text")
    want = sorted(((i, (t or "").replace("▁", " ")) for i, t in odd_rows()), key=repr)
    assert back == want
    assert unigram.encode(df.limit(0), PIECES).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert unigram.decode(none, PIECES).collect()[0].text is None


def test_double_array_holds_its_keys():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "über", "ü", "zz"])}
    trie = unigram.DoubleArray(keys)
    for key in [*keys, b"x", b"abcd", b"ac"]:
        at = 0
        for c in key:
            to = int(trie.base[at]) + c
            if to >= len(trie.check) or trie.check[to] != at:
                at = None
                break
            at = to
        assert (-1 if at is None else trie.piece[at]) == keys.get(key, -1)


# -------------------------------------------------------------- languages

TEXTS = {
    "en": "the shore and thing with other nothing worth", "de": "der schein und nicht auch zwischen weich",
    "fr": "le eau des oiseaux et queue beau nouveau",
}


def spoken(spark, n):
    return documents(spark, [(i, prose(i, 60, TEXTS[k].split()), k, "s", 0) for i in range(n) for k in [list(TEXTS)[i % 3]]])


def test_languages_held_out(spark):
    df = spoken(spark, 120).withColumn("held_out", crf.held_out())
    model = crf.train(df.filter("not held_out"))
    got = crf.identify(df, model, ["doc_id", "held_out", "lang"]).collect()
    assert {r.held_out for r in got} == {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got} == {True, False}
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_languages_of_code_switched_words(spark):
    model = crf.train(spoken(spark, 90))
    mixed = documents(spark, [(1, f"{TEXTS['en']} {TEXTS['de']} {TEXTS['fr']}")])
    runs = crf.identify(mixed, model, ["doc_id"], runs=True).collect()[0].runs
    assert [r.lang for r in runs] == ["en", "de", "fr"]
    assert [r["from"] for r in runs] == [0, 8, 15]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    score, transition = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    marginal, pairs, _ = crf._marginals(score, np.array([4]), transition)
    weight, total, want, moves = 0.0, 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        value = sum(score[0, t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
        weight = math.exp(value)
        total += weight
        for t, y in enumerate(path):
            want[t, y] += weight
        for a, b in zip(path, path[1:]):
            moves[a, b] += weight
    assert np.allclose(marginal[0], want / total) and np.allclose(pairs, moves / total)
    labelled = crf._label(score.astype(np.float32), np.array([4]), transition)
    assert np.allclose(labelled[0], want / total, atol=1e-5)


def test_languages_of_odd_rows(spark):
    model = crf.train(spoken(spark, 60))
    df = documents(spark, odd_rows() + [(13, "12 #!")])
    got = rows_of(crf.identify(clashing(df), model, ["doc_id"]), "doc_id", "lang_pred", "score")
    assert len(got) == len(odd_rows()) + 1
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (13, "und", 0.0)} <= set(got)
    assert got == rows_of(crf.identify(df, model, ["doc_id"]), "doc_id", "lang_pred", "score")
    assert crf.identify(df.limit(0), model, ["doc_id"]).count() == 0
    nothing = crf.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None
    assert {r.lang_pred for r in crf.identify(df, nothing, ["doc_id"]).collect()} == {"und"}


# ----------------------------------------------------------------- scores


def scored_by_hand(train, texts, order, most):
    """Prediction by partial matching, symbol by symbol."""

    def symbols(text):
        return [*b" ".join((text or "").encode().lower().split()), ppm.END]

    counts, total = collections.defaultdict(collections.Counter), 0
    for text in train:
        line = [ppm.END] * order + symbols(text)
        for i in range(order, len(line)):
            total += 1
            for d in range(order + 1):
                counts[tuple(line[i - d : i])][line[i]] += 1
    known = {c for c, n in counts.items() if sum(n.values()) * most >= total}
    out = []
    for text in texts:
        line, log = [ppm.END] * order + symbols(text), 0.0
        for i in range(order, len(line)):
            depth = 0
            while depth < order and tuple(line[i - depth - 1 : i]) in known:
                depth += 1
            excluded, p = set(), 1.0
            for d in range(depth, -1, -1):
                seen = {s: n for s, n in counts.get(tuple(line[i - d : i]), {}).items() if s not in excluded}
                if not seen:
                    continue
                escape = 0 if len(excluded | set(seen)) == 257 else len(seen)
                whole = sum(seen.values()) + escape
                if line[i] in seen:
                    p *= seen[line[i]] / whole
                    break
                p *= escape / whole
                excluded |= set(seen)
            else:
                p /= 257 - len(excluded)
            log += math.log10(p)
        out.append(log)
    return out


@pytest.mark.parametrize(("order", "most"), [(2, 1 << 14), (5, 40)])
def test_scores_against_plain_ppm(spark, monkeypatch, order, most):
    monkeypatch.setattr(ppm, "COMMON", 20)
    rows = [(i, prose(i, 5 + i % 30)) for i in range(40)] + odd_rows()[:4] + [(50, "unseen Ω words"), (6, "x"), (6, "x")]
    df = documents(spark, rows).withColumn("held_out", ppm.held_out())
    got = ppm.score(clashing(df), order, most).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    counts = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), h, ws, log in zip(rows, held, tokens, scored_by_hand(train, [t for _, t in rows], order, most)):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None])
        known = sum(counts[w] > 0 for w in [*ws, None])
        want.append((i, h, len(ws) + 1, known, n, round(base, 6), round(log, 2)))
    have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_scores_without_training_rows(spark):
    df = documents(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    got = {r.doc_id: r for r in ppm.score(df).collect()}
    assert got[1].base_score == 0.0 and got[1].train_tokens == 0 and got[1].n_known == 0
    assert got[1].score == pytest.approx(-4 * math.log10(257)) and got[2].score == pytest.approx(-math.log10(257))
    assert ppm.score(df.limit(0)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = ppm.contexts(documents(spark, [(i, prose(i, 20)) for i in range(10)]), 3, 500)
    _, cost = ppm.Trie(rows).tables()
    assert np.allclose((10.0 ** cost.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_rare_contexts_stay_in_the_trie(spark, monkeypatch):
    """Contexts seen once count as before beside any number of common symbols, looked up or joined."""
    rows = [(i, "ab " * 2000) for i in range(12)] + [(20 + i, prose(i, 20)) for i in range(12)] + [(2, "qzx qzx vwk")]
    df = documents(spark, rows).withColumn("held_out", F.col("doc_id") % 6 == 2)
    want = scored_by_hand([t for i, t in rows if i % 6 != 2], [t for _, t in rows], ppm.ORDER, 1 << 60)
    for looked_up in (1 << 21, 100, 0):
        monkeypatch.setattr(ppm, "STRINGS", looked_up)
        got = ppm.score(df).collect()
        assert sorted((r.doc_id, round(r.score, 2)) for r in got) == sorted((i, round(x, 2)) for (i, _), x in zip(rows, want))
