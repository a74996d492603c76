"""Reusable measures: functions of columns, usable in any aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(value: Column, where: Column | None = None) -> Column:
    """Sum of a value, of the rows a filter keeps."""
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, null for an empty base."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def concentration(df: DataFrame, member: str, value: str, n: int) -> DataFrame:
    """Share of the n largest members in the whole; ties at the border are kept."""
    per = df.groupBy(member).agg(F.sum(value).alias("v"))
    # One number reaches the driver, so that no join is needed to compare with it.
    border = per.orderBy(F.desc("v")).limit(n).agg(F.min("v")).first()[0]
    sums = per.agg(F.sum(F.when(F.col("v") >= F.lit(border), F.col("v"))).alias("top_value"), F.sum("v").alias("all_value"))
    return sums.withColumn("top_share", share(F.col("top_value"), F.col("all_value")))


def unpivot_sources(df: DataFrame, columns: dict[str, str], by: list[str], name: str = "source", value: str = "value") -> DataFrame:
    """Per-source columns to rows."""
    cells = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()])
    return df.select(*by, F.inline(cells))
