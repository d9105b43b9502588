"""Small inputs for the training-data operators, and what every one of them must bear."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = (
    "n_words n_removed repeats score word n code block shard fp text_key label at row runs lang_pred held_out rank "
    "length part number before component_id class_fp a b first name other host path rule verdict query_id v"
).split()
WORDS = "the of and Tier, maison ünder naïve 漢字 x. y! ## a|b 12 über der die que les la".split(" ")


def documents(spark, rows):
    full = [(i, t, *(rest or ("en", "s", None if t is None else len(t)))) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    """The same rows with more columns, named like those that operators add."""
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def prose(seed, n, words=WORDS):
    """n words with varying blanks between them."""
    rng = random.Random(seed)
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(n))


def odd_rows():
    """Nulls, empty, blank, very long, repeated rows, null ids, ties."""
    long_text = prose(5, 30_000)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a b c"), (None, prose(6, 80)), (4, long_text),
        (5, "x"), (5, "x"), (6, prose(7, 60)), (6, prose(7, 60)), (7, prose(7, 60)), (8, "word " * 3000),
        (9, "no-blank-" * 2000), (10, prose(8, 60) + "\n" + prose(9, 40)), (11, prose(10, 30) + prose(9, 40)),
        (12, "\x00 ▁ � \U0001f600 é"),
    ]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
