"""Data-quality rules: each is a frame of failing rows with a severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named check; ``failing`` gives the rows that break it, ``severity`` is block or warn."""

    name: str
    failing: Callable[[], DataFrame]
    severity: str = "block"


def not_null(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def accepted_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.where(bad)


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def one_unknown_member(dim: DataFrame, key: str, member: str = "-1") -> DataFrame:
    return dim.agg(F.count_if(F.col(key).cast("string") == member).alias("members")).where("members <> 1")


def one_per_group(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(flag)).alias("flagged")).where("flagged <> 1")


def reconciles(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """One row (name, left, right, status): counts of two layers."""
    both = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    sums = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))
    return sums.select(F.lit(name).alias("check"), "left_rows", "right_rows", F.when(F.col("left_rows") == F.col("right_rows"), "OK").otherwise("CHECK").alias("status"))


def freshness(df: DataFrame, loaded_at: str, as_of: Column, warn_days: int = 8, error_days: int = 15, by: list[str] | None = None) -> DataFrame:
    """Age of the newest row per source and its status."""
    out = df.groupBy(*(by or [])).agg(F.max(loaded_at).alias("newest")).withColumn("age_days", F.datediff(as_of, F.to_date("newest")))
    return out.withColumn("status", F.when(F.col("age_days") > error_days, "error").when(F.col("age_days") > warn_days, "warn").otherwise("pass"))


def run_rules(rules: list[Rule]) -> DataFrame:
    """(rule, severity, failures, status) of all rules in one frame."""
    if not rules:
        raise ValueError("no rules given")
    rows = [r.failing().agg(F.count(F.lit(1)).alias("failures")).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), "failures", F.when(F.col("failures") == 0, "pass").when(F.lit(r.severity) == "warn", "warn").otherwise("fail").alias("status")) for r in rules]
    return reduce(DataFrame.unionByName, rows)
