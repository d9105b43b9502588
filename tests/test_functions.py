import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voxmetric.functions import cleaning, matching, rounding, scores


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def exact(n, d, digits):
    if d == 0:
        return None
    scaled = abs(Fraction(n, d)) * 10**digits
    whole = int(scaled + Fraction(1, 2))
    return (whole if n >= 0 else -whole) / 10**digits


def test_rounded_ratio_is_half_away_from_zero(spark):
    rng = random.Random(3)
    pairs = [(1005, 1000), (-1005, 1000), (5, 1000), (-5, 1000), (1, 3), (7, 0), (10**9, 7)]
    pairs += [(rng.randint(-10**6, 10**6), rng.randint(1, 5000)) for _ in range(300)]
    df = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(pairs)], "i int, n bigint, d bigint")
    for digits in (0, 1, 2, 6):
        got = [
            r[0]
            for r in df.orderBy("i")
            .select(rounding.rounded_ratio(F.col("n"), F.col("d"), digits))
            .collect()
        ]
        assert got == [exact(n, d, digits) for n, d in pairs]


def test_scores(spark):
    values = ["8.9", "-0.5", "11", "-1", "abc", "", "9d", None, " 7 ", "1e1", "nan", "10.0"]
    assert column(spark, values, cleaning.score) == [8, 0, None, None, None, None, None, None, 7, 10, None, 10]


def test_dates(spark):
    d = dt.date
    values = ["01/02/2024", "12/25/2024", "2024-02-01", "1-2-2024", "1.2.2024", "  ", "31/31/2000", "2024-05-06T07:08:09Z", "3 Mar 2024", "01/02/24", "1/2/2024 10:15:00", "12/31/99", "3-4-70", "5.6.68"]
    want = [d(2024, 2, 1), d(2024, 12, 25), d(2024, 2, 1), d(2024, 2, 1), d(2024, 2, 1), None, None, d(2024, 5, 6), d(2024, 3, 3), d(2024, 2, 1), d(2024, 2, 1), d(1999, 12, 31), d(1970, 4, 3), d(2068, 6, 5)]
    assert column(spark, values, cleaning.parse_date) == want
    assert column(spark, ["01/02/2024"], lambda c: cleaning.parse_date(c, month_first=True)) == [d(2024, 1, 2)]
    assert column(spark, [45000], cleaning.serial_date, "int") == [d(2023, 3, 15)]


def test_comments(spark):
    values = [" N.v.t. ", "nvt", "\t\n", None, " goed \n", "NVT!", "x" * 50]
    assert column(spark, values, cleaning.comment) == [None, None, None, None, "goed", "NVT!", "x" * 50]
    assert column(spark, ["a  b\n c", "", None, " \t "], cleaning.word_count) == [3, 0, 0, 0]
    assert column(spark, ["a", " ", None], cleaning.has_explanation) == [True, False, False]


def test_yes_no(spark):
    assert column(spark, [" Ja", "NO", "1", "false", "x", None], cleaning.yes_no) == [True, False, True, False, None, None]


def test_names(spark):
    names = ["question_1_ux_test", "response_text_UX app", "café bar", "  a_b"]
    assert column(spark, names, cleaning.theme_display_name) == ["Ux Test", "UX App", "Café Bar", "A B"]
    assert column(spark, ["question_2_what_now", "other_field"], cleaning.question_label) == ["What Now", "Other Field"]
    assert column(spark, [" Te Duur! ", "a--b", "!!"], cleaning.slug) == ["te-duur", "a-b", ""]
    assert column(spark, ["App  Ervaring"], cleaning.theme_id) == ["app_ervaring"]


def test_score_classes(spark):
    got = column(spark, [6, 7, 8, 9, None], scores.category, "int")
    assert got == ["detractor", "passive", "passive", "promoter", None]


def test_sunday_week(spark):
    got = column(spark, [dt.date(2024, 1, 7), dt.date(2024, 1, 6)], cleaning.week_start_sunday, "date")
    assert got == [dt.date(2024, 1, 7), dt.date(2023, 12, 31)]


@pytest.mark.parametrize("seed", range(3))
def test_keyword_pruning_keeps_first_label(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    rules = [(f"r{i}", [word() for _ in range(4)]) for i in range(5)]
    texts = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(200)]
    want = [next((l for l, ws in rules if any(w in t for w in ws)), None) for t in texts]
    assert column(spark, texts, lambda c: matching.first_label(c, rules)) == want


def test_priority(spark):
    df = spark.createDataFrame([(-21.0, 1.0), (5.0, 61.0), (-1.0, 1.0), (10.0, 1.0), (30.0, 26.0), (30.0, 10.0)], "n double, d double")
    got = [r[0] for r in df.select(scores.priority_level(F.col("n"), F.col("d"))).collect()]
    assert got == ["critical", "critical", "high", "medium", "medium", "low"]
