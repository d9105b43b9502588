"""Potentials of new words are summed a batch at a time."""

import numpy as np

from voxmetric.llm import crf

ROWS = [("de krant is te laat bezorgd en de prijs is hoog", "nl"), ("the paper was late again and the price is high", "en")] * 20


def by_hand(model, word):
    letters = crf._letters(word)
    at = crf._features(letters)
    score = sum((model.weights[a].astype(float) for a in at), np.zeros(len(model.languages)))
    odds = model.lexicon.get(letters) if at else None
    return score if odds is None else score + odds.astype(float) * model.lexicon_weight


def test_one_sum_for_all_new_words(monkeypatch):
    model = crf.fit(ROWS)
    calls, potential = [], crf.Model.potential
    monkeypatch.setattr(crf.Model, "potential", lambda self, words: (calls.append(words), potential(self, words))[1])
    monkeypatch.setattr(crf, "_REMEMBERED", 900)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)] + ["price", "Krant,", "123", "--", ""]
    kept = model.kept()
    texts = [" ".join(words), None, "", "12 34", "price krant " * 50]
    first = crf._judge(kept, texts)
    # One call for each 4096 new words, not one for each word.
    assert len(calls) == 1
    assert crf._judge(kept, texts) == first and crf._judge(kept, ["the price"] + texts)[0][1:] == first[0]
    rows = crf._Potentials(model)
    ids = [rows[w] for w in words]
    rows.fill()
    for i, w in zip(ids, words):
        np.testing.assert_allclose(rows.rows[i, :-1], by_hand(model, w), rtol=1e-4, atol=1e-5)
        assert rows.rows[i, -1] == bool(crf._letters(w))
