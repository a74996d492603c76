"""Semi-structured payloads as VARIANT: paths, arrays, envelopes, name-value lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(c: Column, strict: bool = False) -> Column:
    """JSON text to VARIANT; strict mode aborts on text that isn't JSON, else it is null."""
    return F.parse_json(c) if strict else F.try_parse_json(c)


def at(v: Column, path: str, kind: str = "string") -> Column:
    """Value at a path, null where it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def is_array(v: Column, path: str = "$") -> Column:
    """Whether an array stands at the path; an empty one does, an error body doesn't."""
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def explode_array(df: DataFrame, v: str, path: str = "$", outer: bool = False) -> DataFrame:
    """One row per element (``pos``, ``item``); none (or with ``outer`` one) for a missing array."""
    items = F.try_variant_get(F.col(v), path, "array<variant>")
    kept = [F.col(c) for c in df.columns if c not in ("pos", "item")]
    return df.select(*kept, (F.posexplode_outer if outer else F.posexplode)(items).alias("pos", "item"))


def pivot_names(df: DataFrame, by: list[str], name: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """Name-value rows to columns: ``wanted`` maps a name to its column."""
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(c) for n, c in wanted.items()])


def compact_join(sep: str, *parts: Column) -> Column:
    """Non-null parts joined, null if there is none."""
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))
