"""Landed JSON files and pages: scan, success semantics, resumable plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.dates import board_from_path, business_date, ingest_date_from_path
from sightline.operators.semistructured import at, is_array, parse

#: Sources and how their payload is laid out: the path of the array, and whether an envelope is around it.
LAYOUTS = {"ashby": ("$.jobs", False), "greenhouse": ("$.jobs", False), "workable": ("$.jobs", False), "smartrecruiters": ("$", False), "jooble": ("$.jobs", True), "jsearch": ("$.data", True)}


def check_sources(names: list[str]) -> list[str]:
    """The given source names; an unknown one is an error."""
    unknown = sorted(set(names) - set(LAYOUTS))
    if unknown:
        raise ValueError(f"unknown source: {', '.join(unknown)}; known are {', '.join(sorted(LAYOUTS))}")
    return list(names)


def scan(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """One row per landed file: raw_data (VARIANT), file_name, loaded_at, board, ingest_date.

    ``strict`` aborts on a file that isn't JSON; else its raw_data is null.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder)
    path = F.col("_metadata.file_path")
    return files.select(parse(F.col("value"), strict).alias("raw_data"), path.alias("file_name"), F.col("_metadata.file_modification_time").alias("loaded_at"), board_from_path(path).alias("board"), ingest_date_from_path(path).alias("ingest_date"))


def landed_files(raw: DataFrame, source: str, zone: str = "Asia/Riyadh") -> DataFrame:
    """Success of each landed file: an array counts (an empty one too), an error body doesn't."""
    path, envelope = LAYOUTS[check_sources([source])[0]]
    body = F.try_parse_json(at(F.col("raw_data"), "$.response_raw")) if envelope else F.col("raw_data")
    out = raw.withColumn("_b", body)
    ok = is_array(F.col("_b"), path)
    if envelope:
        ok = ok & (at(F.col("raw_data"), "$.http_status", "int") == 200)
    if envelope:
        # Pages of a query are no boards: the source is one, and its day that of the request.
        asked = business_date(at(F.col("raw_data"), "$.ingested_at", "timestamp"), zone)
        out = out.withColumn("board", F.lit(source)).withColumn("ingest_date", F.coalesce(asked, F.col("ingest_date")))
    return out.select(F.lit(source).alias("source_name"), "board", "ingest_date", "file_name", "loaded_at", F.coalesce(ok, F.lit(False)).alias("is_successful"), F.coalesce(F.size(F.try_variant_get("_b", path, "array<variant>")), F.lit(0)).alias("postings"))


def missing_pages(planned: DataFrame, landed: DataFrame, key: list[str], status: str = "http_status") -> DataFrame:
    """Planned pages that haven't landed with HTTP 200 yet: what a resumed run fetches."""
    return planned.join(landed.where(F.col(status) == 200).select(*key).distinct(), key, "left_anti")


def should_stop(log: DataFrame, order: str, new: str, last: int = 5, least: float = 2.0) -> DataFrame:
    """The first query of a log after which the mean yield of the last ``last`` fell below ``least``."""
    frame = W.partitionBy("source_name").orderBy(order).rowsBetween(-(last - 1), 0)
    means = log.withColumn("mean_yield", F.avg(new).over(frame)).withColumn("queries", F.count(new).over(frame))
    return means.where((F.col("queries") == last) & (F.col("mean_yield") < least)).groupBy("source_name").agg(F.min(order).alias("stop_at"))
