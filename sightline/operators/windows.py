"""Window idioms Spark SQL has no word for: QUALIFY, ties, observation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def qualify_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per key in a total order; Spark turns it into a group limit before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n_with_ties(df: DataFrame, n: int, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows whose value ranks among the n greatest; ties at the border stay.

    Without ``by`` the border value is found by a distributed top-k and rows are filtered by
    it, so that no window over all rows runs in one task.
    """
    if by:
        return df.withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("_r") <= n).drop("_r")
    border = df.orderBy(F.desc(value)).limit(n).agg(F.min(value)).first()[0]
    return df.where(F.col(value) >= F.lit(border))


def latest_snapshot(df: DataFrame, key: list[str], order: list[Column], seen: str) -> DataFrame:
    """The latest copy per key with first_seen, last_seen and copies_landed over all its copies."""
    w = W.partitionBy(*key)
    out = df.withColumn("first_seen", F.min(seen).over(w)).withColumn("last_seen", F.max(seen).over(w)).withColumn("copies_landed", F.count(F.lit(1)).over(w))
    return qualify_first(out, key, order)


def count_distinct_over(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Adds count(distinct x) over (partition by ...), nulls not counted.

    Counted in two aggregates and joined back, so that no partition's values sit in one
    buffer; null keys are a partition.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.countDistinct(column).alias(name))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    return df.join(counts, same).drop(*keys)


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "middle") -> DataFrame:
    """Median per key, interpolated, nulls left out, from counts of equal values.

    Equal values are counted before the shuffle, and a key's running total needs its sorted
    counts only; a key without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by)
    ranked = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    holds = lambda at: (F.col("_to") >= at) & (F.col("_to") - F.col("_n") < at)
    middle = (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2
    return ranked.groupBy(*by).agg(middle.alias(name))


def share_within(value: Column, by: list[str]) -> Column:
    """Per cent of a partition's total, one decimal; null where the total is 0."""
    total = F.sum(value).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))
    return F.round(F.try_divide(100.0 * value, total), 1)


def mode_with_tiebreak(df: DataFrame, by: list[str], value: str, tie: list[Column] | None = None) -> DataFrame:
    """Most frequent value per key; ties by the given order, then by the value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return qualify_first(counted, by, [F.desc("n"), *(tie or []), F.asc(value)])


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str) -> DataFrame:
    """n rows per stratum in the order of a hash: the same rows on every run."""
    return qualify_n(df, strata, [F.md5(F.col(key).cast("string")), F.col(key)], n)


def qualify_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
