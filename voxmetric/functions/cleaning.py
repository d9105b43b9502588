"""Cleaning of survey export fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .matching import let

# Whitespace sets. ``F.trim`` alone removes the blank only; text that may hold
# line breaks, tabs or no-break blanks is stripped of one of these. They are
# plain character sets: trimming and translating them is several times faster
# than a regular expression over a long comment.
_UNICODE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES = "\t\n\x0b\f\r " + _UNICODE_SPACES + "\ufeff"
SPACES_WITH_CONTROLS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85" + _UNICODE_SPACES

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted date layouts in order of preference: day-first wins over
# month-first on ambiguous input. The last group is the lenient tail.
DATE_LAYOUTS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$", "d/M/yyyy H:mm"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}$", "d-M-yyyy H:mm"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d/M/yyyy H:mm:ss"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d-M-yyyy H:mm:ss"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "d/M/yy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "M/d/yy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$", "d-M-yy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2}$", "d.M.yy"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$", "d MMMM yyyy"),
)
# A year of two digits from here on belongs to the last century.
_CENTURY_TURNS = 2069
_ISO_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"

MISSING_COMMENTS = ("", "n.v.t.", "nvt")
YES_WORDS = ("ja", "yes", "true", "1")
NO_WORDS = ("nee", "no", "false", "0")


def strip(col: Column, spaces: str = SPACES) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.trim(col, F.lit(spaces))


def split_words(col: Column, spaces: str = SPACES, others: str = "") -> Column:
    """Words between whitespace (and ``others``); may hold empty strings."""
    marks = spaces.replace(" ", "") + others
    return F.split(F.translate(col, marks, " " * len(marks)), " ")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def score(col: Column) -> Column:
    """Score text to 0..10: decimals are cut off, anything else is NULL."""

    def parse(text: Column) -> Column:
        value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
        whole = F.when((value > -1) & (value < 11), value.cast("int"))
        return F.when(whole.between(0, 10), whole)

    return let(strip(col.cast("string"), SPACES_WITH_CONTROLS), parse)


def _century(day: Column, layout: str) -> Column:
    if "yyyy" in layout:
        return day
    return F.when(F.year(day) >= _CENTURY_TURNS, F.add_months(day, -1200)).otherwise(day)


def parse_date(col: Column, *, month_first: bool = False) -> Column:
    """Date text in any accepted layout, else NULL."""
    day_first, us_style, *others = DATE_LAYOUTS
    head = [us_style, day_first] if month_first else [day_first, us_style]

    def parse(text: Column) -> Column:
        attempts = [
            F.when(text.rlike(shape), _century(F.try_to_date(text, layout), layout))
            for shape, layout in [*head, *others]
        ]
        stamp = F.when(text.rlike(_ISO_STAMP), F.try_to_date(F.substring(text, 1, 10)))
        return F.coalesce(*attempts, stamp)

    return let(strip(col.cast("string"), SPACES_WITH_CONTROLS), parse)


def serial_date(col: Column) -> Column:
    """Spreadsheet day number (day 0 is 1899-12-30) to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), col.cast("int"))


def yes_no(col: Column) -> Column:
    text = F.lower(strip(col.cast("string"), SPACES_WITH_CONTROLS))
    return F.when(text.isin(*YES_WORDS), True).when(text.isin(*NO_WORDS), False)


def comment(col: Column) -> Column:
    """Trimmed comment; blank and 'not applicable' marks become NULL."""
    longest = max(map(len, MISSING_COMMENTS))

    def keep(text: Column) -> Column:
        # Only short texts are folded and compared.
        missing = (F.length(text) <= longest) & F.lower(text).isin(*MISSING_COMMENTS)
        return F.when(~missing, text)

    return let(strip(col, SPACES_WITH_CONTROLS), keep)


def is_empty_comment(col: Column) -> Column:
    return comment(col).isNull()


def title(preferred: Column, fallback: Column) -> Column:
    return F.coalesce(blank_to_null(preferred), blank_to_null(fallback))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; 0 for NULL and blank."""
    words = F.filter(split_words(col, SPACES_WITH_CONTROLS), lambda w: w != "")
    return F.coalesce(F.array_size(words), F.lit(0))


def has_explanation(col: Column) -> Column:
    return F.coalesce(F.length(strip(col, SPACES_WITH_CONTROLS)) > 0, F.lit(False))


def or_unknown(col: Column) -> Column:
    return F.coalesce(col, F.lit("Unknown"))


def slug(col: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one dash."""
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+\z", "")


def theme_key(col: Column) -> Column:
    """Lower case without surrounding blanks."""
    return F.lower(F.trim(col))


def capitalise_words(col: Column) -> Column:
    """Upper-case the first letter of each ASCII word, leave the rest alone."""
    pieces = F.split(col, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    raised = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike("^[A-Za-z0-9_]"),
            F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))),
        ).otherwise(p),
    )
    return F.array_join(raised, "")


def theme_display_name(col: Column) -> Column:
    """Readable theme name: prefix dropped, underscores to blanks, capitalised."""
    bare = F.regexp_replace(col, r"^(question_[0-9]+_|response_text_)", "")
    return strip(capitalise_words(F.regexp_replace(bare, "_", " ")))


def question_label(col: Column) -> Column:
    """Readable question label from a column name."""
    bare = col
    for n in range(1, 5):
        first = F.instr(bare, f"question_{n}_")
        size = len(f"question_{n}_")
        cut = F.concat(
            F.substring(bare, F.lit(1), first - 1),
            F.substring(bare, first + size, F.length(bare)),
        )
        bare = F.when(first > 0, cut).otherwise(bare)
    return capitalise_words(F.regexp_replace(bare, "_", " "))


def theme_id(col: Column) -> Column:
    """Snake-case identifier."""
    return F.regexp_replace(F.lower(col), f"[{SPACES}]+", "_")


def clamp_unit(col: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col))


def snippet(col: Column, size: int, mark: str = "...") -> Column:
    return F.concat(F.substring(col, 1, size), F.lit(mark))


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def week_start_sunday(col: Column) -> Column:
    return F.date_sub(col, F.dayofweek(col) - 1)
