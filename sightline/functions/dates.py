"""Dates, business days and what file paths say about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_date(ts: Column, zone: str = "Asia/Riyadh") -> Column:
    """Calendar day of an instant in the business zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def week_start(d: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def date_key(d: Column) -> Column:
    """Day as an integer YYYYMMDD, -1 for none."""
    return F.coalesce(F.date_format(d, "yyyyMMdd").cast("int"), F.lit(-1))


def board_from_path(path: Column) -> Column:
    """Board of a landed file: its name without '.json' and '_jobs'."""
    return F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(-1)), r"(_jobs)?\.json$", "")


def ingest_date_from_path(path: Column) -> Column:
    """Day of the path's ingest_date folder, null if it has none."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"ingest_date=(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
