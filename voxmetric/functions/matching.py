"""Keyword tests on text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain expression would repeat the computation for every use, which for
    lower-casing a long comment against dozens of keywords dominates the query.
    """
    return F.transform(F.array(value), body)[0]


def needed(words: Sequence[str], known: Sequence[str] = ()) -> list[str]:
    """Words that can still decide a test after the ``known`` ones failed.

    A text with a longer word also holds every part of it, so a word that
    contains a shorter one (or one tested before) is never the deciding one.
    """
    kept: list[str] = []
    for word in sorted(dict.fromkeys(words), key=len):
        if not any(k in word for k in (*known, *kept)):
            kept.append(word)
    return [w for w in dict.fromkeys(words) if w in kept]


def sql_text(value: str) -> str:
    """String literal for use inside an SQL expression."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def word_array(words: Sequence[str]) -> Column:
    """Constant array of words, folded to one literal by the optimiser."""
    return F.expr("array(" + ", ".join(map(sql_text, words)) + ")")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the text; NULL for NULL text."""
    return F.exists(word_array(needed(words)), lambda w: text.contains(w))


def first_label(
    text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | None = None
) -> Column:
    """Label of the first rule with a keyword in the lower-cased text."""

    def chain(low: Column) -> Column:
        out, seen = F.when(F.lit(False), ""), []
        for label, words in rules:
            left = needed([w.lower() for w in words], seen)
            if left:
                out = out.when(contains_any(low, left), label)
                seen += left
        return out if default is None else out.otherwise(default)

    return let(F.lower(text), chain)
