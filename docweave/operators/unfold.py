"""Arrays to rows.

A plain explode lets the optimizer derive the filter size(array) > 0 and push it below the
projections that build the array, so an expensive array is computed again for the filter. The
outer form derives no such filter; the rows of empty arrays are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, array: Column | str, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    array = F.col(array) if isinstance(array, str) else array
    generator = F.explode_outer(array).alias(name)
    if position:
        generator = F.posexplode_outer(array).alias(position, name)
    return df.select(*keep, generator).where(F.col(name).isNotNull())
