"""A bit table of hashed ids that lets rows of other ids be left out before costly work.

A row whose id was given always passes; another passes by chance. The table has about ``BITS_PER_ID`` bits an id, so
that one in sixteen or fewer passes, and never more than ``MAX_BITS`` (8 MB), which bounds what the driver gathers and
broadcasts: beyond four million ids more rows pass, up to all of them. What must be exact is joined afterwards, on
the narrow rows that the costly work leaves.

Defined cases: a null id passes as any id of its hash does; without ids (nearly) nothing passes; repeated ids count once
more towards the size, no more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID = 16
MAX_BITS = 1 << 26


def _table(ids: DataFrame, column: str, max_bits: int) -> np.ndarray:
    bits = min(max_bits, 1 << max(10, (ids.count() * BITS_PER_ID - 1).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (
        ids.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("held"))
        .toPandas()
    )
    table = np.zeros(bits >> 6, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["held"].to_numpy(np.int64)
    return table.view(np.uint64)


def sieve(ids: DataFrame, column: str, max_bits: int = MAX_BITS) -> Callable[[str | Column], Column]:
    """A test for columns of the type of ``ids``' column: false only where the value is not among the ids.

    Two jobs over ``ids`` start at once.
    """
    shared = ids.sparkSession.sparkContext.broadcast(_table(ids, column, max_bits))

    @F.pandas_udf("boolean")
    def passes(hashed: pd.Series) -> pd.Series:
        at = hashed.to_numpy(np.int64).view(np.uint64) & np.uint64(len(shared.value) * 64 - 1)
        word = shared.value[(at >> np.uint64(6)).astype(np.int64)]
        return pd.Series((word >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return lambda c: passes(F.xxhash64(c))
