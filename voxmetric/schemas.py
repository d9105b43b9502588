"""Canonical schemas of the survey tables."""

from pyspark.sql import types as T

_S = T.StringType()


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


RESPONSES = _fields(
    ("id", T.LongType()),
    ("survey_name", _S),
    ("nps_score", T.IntegerType()),
    ("nps_explanation", _S),
    ("gender", _S),
    ("age_range", _S),
    ("years_employed", _S),
    ("creation_date", T.DateType()),
    ("title_text", _S),
    ("nps_category", _S),
    ("word_count", T.IntegerType()),
    ("has_explanation", T.BooleanType()),
    ("created_at", T.TimestampType()),
)

ENRICHMENT = _fields(
    ("response_id", T.LongType()),
    ("themes", T.ArrayType(_S)),
    ("primary_theme", _S),
    ("theme_scores", T.MapType(_S, T.DoubleType())),
    ("sentiment_score", T.DecimalType(3, 2)),
    ("sentiment_label", _S),
    ("keywords", T.ArrayType(_S)),
    ("confidence", T.DoubleType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("processing_status", _S),
    ("model", _S),
    ("summary", _S),
    ("created_at", T.TimestampType()),
)

SURVEY_ANALYSES = _fields(
    ("id", _S),
    ("name", _S),
    ("original_filename", _S),
    ("total_responses", T.LongType()),
    ("response_column", _S),
    ("headers", T.ArrayType(_S)),
    ("question_columns", T.ArrayType(_S)),
    ("is_multi_question", T.BooleanType()),
    ("status", _S),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

AI_ANALYSIS = _fields(
    ("sentiment", _S),
    ("sentiment_score", T.DoubleType()),
    ("themes", T.ArrayType(_S)),
)

SURVEY_RESPONSES = _fields(
    ("survey_id", _S),
    ("row_number", T.LongType()),
    ("response_text", _S),
    ("question_text", _S),
    ("question_order", T.IntegerType()),
    ("metadata", T.MapType(_S, _S)),
    ("ai_analysis", AI_ANALYSIS),
)

THEME_HIERARCHY = _fields(
    ("original_theme", _S),
    ("main_category", _S),
    ("sub_category", _S),
    ("confidence", T.DecimalType(3, 2)),
    ("source", _S),
    ("response_count", T.LongType()),
    ("avg_nps", T.DecimalType(4, 2)),
)

DAILY_ROLLUP_KEYS = ("survey_name", "rollup_date")
