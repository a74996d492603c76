"""Star schema: dimensions with an Unknown member, facts with role-playing date keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.dates import date_key, week_start
from sightline.functions.keys import surrogate_key


def with_unknown(dim: DataFrame, values: dict[str, object]) -> DataFrame:
    """A dimension plus its Unknown member; columns without a value are null."""
    row = dim.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema])
    return dim.unionByName(row)


def dimension(df: DataFrame, key: str, parts: list[str], attributes: list[str]) -> DataFrame:
    """Distinct members with a hashed key; of several rows per key the least attributes win (Type 1)."""
    keyed = df.withColumn(key, surrogate_key(*map(F.col, parts)))
    return keyed.groupBy(key).agg(F.min(F.struct(*[F.col(a) for a in attributes])).alias("_a")).select(key, *[F.col(f"_a.{a}").alias(a) for a in attributes])


def junk_dimension(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Every combination of low-cardinality attributes that occurs."""
    return df.select(*flags).distinct().withColumn(key, surrogate_key(*map(F.col, flags))).select(key, *flags)


def date_dimension(spark: SparkSession, first: str, last: str, most: int = 10_000) -> DataFrame:
    """Days from first to last, with the Unknown member -1; a span of more than ``most`` days is an error."""
    if (date.fromisoformat(last) - date.fromisoformat(first)).days >= most:
        raise ValueError(f"{first} to {last} is more than {most} days")
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as full_date")
    d = F.col("full_date")
    dim = days.select(date_key(d).alias("date_sk"), "full_date", F.date_format(d, "EEEE").alias("day_of_week"), week_start(d).alias("week_start_date"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), (F.weekday(d) + 1).isin(5, 6).alias("is_weekend"))
    return with_unknown(dim, {"date_sk": -1, "is_weekend": False})


def fact(df: DataFrame, keys: dict[str, list[str]], dates: dict[str, str], measures: list[str], unknown: dict[str, Column]) -> DataFrame:
    """Fact rows: hashed foreign keys ('-1' where ``unknown`` says so), date roles as integers."""
    fks = [F.when(unknown[k], "-1").otherwise(surrogate_key(*map(F.col, parts))).alias(k) if k in unknown else surrogate_key(*map(F.col, parts)).alias(k) for k, parts in keys.items()]
    return df.select(*fks, *[date_key(F.col(c)).alias(k) for k, c in dates.items()], *measures)
