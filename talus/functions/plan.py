"""Plan helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows; later filters stay above, so the optimiser does not copy costly columns into each predicate."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` reads it and whatever is made of the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
