"""Surrogate keys and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the part that stands for null in the keys of a public package.
NULL_PART = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*parts: Column) -> Column:
    """md5 of the parts joined by '-', nulls as a sentinel."""
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit(NULL_PART)) for p in parts]))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, hash) that is equal for equal bags of rows, whatever their order."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
