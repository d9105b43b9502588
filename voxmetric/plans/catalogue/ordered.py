"""Ordered reports with the position of each row.

A comparison that sorts both sides would not notice a lost order, so these
variants carry it as a column. Reports are read in their own order first; the
numbering then gathers the finished report, a few rows per title or theme.
"""

from pyspark.sql import DataFrame, Window, functions as F

from . import ingest, mapping, nps, quality, surveys, text, themes, trends  # noqa: F401
from .base import ENTRIES, add


def _numbered(report: DataFrame) -> DataFrame:
    placed = report.select("*", F.monotonically_increasing_id().alias("place"))
    return placed.withColumn("position", F.row_number().over(Window.orderBy("place"))).drop("place")


_ORDERS = {
    "nps_by_survey": "nps_score desc, survey_name",
    "nps_by_title": "nps_score desc, title_text",
    "counts_per_year": "period",
    "trend_monthly": "month",
    "trend_by_survey": "month, survey_name",
    "top_title_moves": "move, mom_delta desc, title nulls last",
    "theme_overview": "mentions desc nulls last, theme",
    "theme_aggregate": "count_responses desc, theme nulls last",
    "hierarchy_listing": "main_category, sub_category, response_count desc, theme_name",
    "survey_severity": "survey_id, severity desc, theme",
    "key_words": '"count" desc, word',
}

for _name, _order in _ORDERS.items():
    _entry = ENTRIES[_name]
    add(
        f"{_name}_in_order", _entry.ids,
        lambda t, e=_entry: _numbered(e.run(t)),
        f"select *, cast(row_number() over (order by {_order}) as int) as position from ({_entry.sql})",
    )
