"""First known value by priority, and what a group's rows say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_known(value: Column, rank: Column, known: Column | None = None) -> Column:
    """Value of the lowest rank among rows where it is known; one aggregate, no window."""
    return F.min_by(value, F.when(value.isNotNull() if known is None else known, rank))


def prefer(value: Column, preferred: Column) -> Column:
    """Least value of the preferred rows, else of any."""
    return F.coalesce(F.min(F.when(preferred, value)), F.min(value))


def representative(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Flags exactly one row per group: the first in a total order."""
    return df.withColumn("is_representative", F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1)
