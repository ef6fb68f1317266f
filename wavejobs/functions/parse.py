"""Text cells of raw files to typed columns; bad text becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import not_nan


def number(c: Column) -> Column:
    return not_nan(c.try_cast("double"))


def epoch_time(c: Column) -> Column:
    return F.timestamp_seconds(number(c))


def semicolon_array(c: Column) -> Column:
    """``"a;b;c"`` as array<double>; an empty or missing cell is an empty array, a bad item null."""
    text = F.trim(c)
    missing = text.isNull() | F.lower(text).isin("", "-", "nan", "none")
    items = F.transform(F.split(text, ";"), lambda x: number(F.trim(x)))
    return F.when(missing, F.array().cast("array<double>")).otherwise(items)
