"""Left join of a large table to a dictionary of unknown size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lookup_join(facts: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; ``dictionary`` must be unique on it.

    No hint: the engine broadcasts a side that it has measured to be small, and
    otherwise splits the partitions of a hot key, copying only the one
    dictionary row. Building the plan starts no job.
    """
    return facts.join(dictionary, key, "left")


def total_of(df: DataFrame, column: str) -> Column:
    """Sum of a column of ``df`` as a scalar to use in a query over ``df``.

    The hash keeps all columns alive in the scalar's plan. Its input is then
    the very plan of ``df``, so Spark reuses the shuffled result instead of
    computing a pruned copy of it. Select what the query needs beforehand.
    """
    total = df.agg(
        F.struct(F.sum(column).alias("s"), F.max(F.xxhash64(*df.columns)).alias("h")).alias("t")
    ).scalar()
    return total["s"]
