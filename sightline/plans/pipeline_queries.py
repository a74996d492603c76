"""Queries of the data-processing operators of the core (units, timestamps, snapshots)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.snapshots import snapshot_changes
from sightline.operators.timestamps import to_utc
from sightline.operators.units import to_common_unit
from sightline.session import bounded_broadcast, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries of all jobs in SAR per month."""
    t = lambda n: table(spark, sf_dir, n)
    out = to_common_unit(t("fct_jobs"), ["job_sk"], "salary_text", "salary_currency", "salary_period", "salary_min_amount", "salary_max_amount", t("seed_currency_rates"), t("seed_period_factors"))
    return out.select("job_sk", F.col("min_common").alias("min_sar_month"), F.col("max_common").alias("max_sar_month"))


# The raw board tables, their identifier and their date field.
DATED = {"nash": ("id", "publishedat"), "eico": ("id", "releaseddate"), "fuku": ("shortcode", "published_on"), "cssmerge_jobs": ("id", "first_published")}


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date fields of the four raw tables with their reading, posterior and UTC instant."""
    one = lambda n: table(spark, sf_dir, n).select(F.lit(n).alias("tbl"), F.col(DATED[n][0]).cast("string").alias("record_id"), "board", F.col(DATED[n][1]).alias("written"), "loaded_at")
    boards = table(spark, sf_dir, "seed_boards").groupBy("board").agg(F.min("time_zone").alias("time_zone"), F.min("date_order").alias("date_order"))
    rows = reduce(DataFrame.unionByName, map(one, DATED)).join(bounded_broadcast(boards), "board", "left")
    return to_utc(rows, "written", ["tbl", "board"], "time_zone", "date_order", seen="loaded_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant per raw record whose date field states a valid moment."""
    return moments(spark, sf_dir).where(F.col("utc_us").isNotNull()).select("tbl", "record_id", F.expr("(utc_us - pmod(utc_us, 1000)) div 1000").alias("utc_ms")).distinct()


def p5_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and reading: values, and values whose interpretation stays open."""
    return moments(spark, sf_dir).groupBy("tbl", F.coalesce("reading", F.lit("none")).alias("reading")).agg(F.count(F.lit(1)).alias("records"), F.count_if("is_ambiguous").alias("ambiguous"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings added, removed or changed between successive successful pulls of each board."""
    t = lambda n: table(spark, sf_dir, n)
    out = snapshot_changes(t("board_snapshots"), t("int_board_pulls"), ["source_name", "board"], "source_job_id", ["title", "location_raw", "employment_type", "salary_raw"], "ingest_date", "loaded_at", "pull_date", "is_successful")
    return out.select("source_name", "board", "source_job_id", F.date_format("snapshot_day", "yyyy-MM-dd").alias("pull_date"), "change_type")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_ambiguous": p5_ambiguous, "p7_found": p7_found}
ORACLE: dict[str, str] = {}
