"""Keyword automaton and theme-name rules against plain substring tests."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmetric.functions import automaton
from voxmetric.functions.automaton import Automaton, found_groups
from voxmetric.operators import mapping
from voxmetric.sources import reference_data as ref


@pytest.mark.parametrize("seed", range(40))
def test_groups_found_in_texts(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(automaton, "PIECE", rng.choice([1, 2, 3, 7, 256]))
    monkeypatch.setattr(automaton, "LANES", rng.choice([1, 5, 1000]))
    letters = "abé漢"

    def word(low, high, more=""):
        return "".join(rng.choice(letters + more) for _ in range(rng.randint(low, high)))

    groups = [[word(seed % 7 and 1, 4) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 70))]
    texts = [None if rng.random() < 0.1 else word(0, 30, "z") for _ in range(rng.randint(0, 20))]
    column = pa.array([*texts, "x"], pa.string()).slice(min(len(texts), seed % 3))
    want = [None if t is None else [i for i, g in enumerate(groups) if any(k in t for k in g)] for t in column.to_pylist()]
    assert Automaton(groups).numbers(column).to_pylist() == want


def test_column(spark):
    rows = spark.createDataFrame([(1, "te duur, slechte service"), (2, None), (3, ""), (4, "x" * 100_000 + "duur")], "id int, t string")
    found = rows.select("id", found_groups(F.col("t"), [["service", "hulp"], ["duur"]]).alias("g")).collect()
    assert {r.id: r.g for r in found} == {1: [0, 1], 2: None, 3: [], 4: [1]}


def test_name_rules_against_a_chain_of_tests():
    rules, patterns = mapping._name_rules(), ref.theme_patterns()

    def by_hand(name):
        for i, (p, _, _) in enumerate(patterns):
            if p == name:
                return i
        for i, (p, _, _) in enumerate(patterns):
            if p != ref.CATCH_ALL and (p in name or name in p):
                return len(patterns) + i
        for j, (_, _, words) in enumerate(ref.THEME_KEYWORD_FAMILIES):
            if any(w in name for w in words):
                return 2 * len(patterns) + j
        return rules.none

    rng = random.Random(1)
    known = [p for p, _, _ in patterns] + [w for _, _, ws in ref.THEME_KEYWORD_FAMILIES for w in ws]
    names = [*known, "", "zz", ref.CATCH_ALL]
    for _ in range(2000):
        word = rng.choice(known)
        a, b = sorted(rng.choices(range(len(word) + 1), k=2))
        names += [word[a:b], rng.choice("xyz ") + word[a:], word + rng.choice(known)[:3]]
    assert rules.numbers(pa.array(names)).to_pylist() == [by_hand(n) for n in names]


def test_a_batch_is_worked_on_in_slices(monkeypatch):
    monkeypatch.setattr(automaton, "SLICE", 100)
    machine, seen, hits = Automaton([["ab"], ["z"]]), [], Automaton.hits
    monkeypatch.setattr(Automaton, "hits", lambda self, texts: (seen.append(len("".join(t or "" for t in texts.to_pylist()))), hits(self, texts))[1])
    texts = [("x" * (i % 40) + "ab", None, "", "z" * 130)[0 if i % 7 else i % 4] for i in range(200)]
    want = [None if t is None else [i for i, w in enumerate(("ab", "z")) if w in t] for t in texts]
    assert machine.numbers(pa.array(texts, pa.string()).slice(3)).to_pylist() == want[3:]
    assert len(seen) > 20 and max(seen) <= 100 + 130
    assert machine.numbers(pa.array([], pa.string())).to_pylist() == []
