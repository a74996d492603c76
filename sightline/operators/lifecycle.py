"""Lifecycle of observed listings, inferred from a calendar of pulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.dates import week_start


def board_activity(copies: DataFrame, key: list[str], board: list[str], day: str) -> DataFrame:
    """Per listing: last day seen and whether it stood in its own board's latest pull."""
    latest = copies.groupBy(*board).agg(F.max(day).alias("board_latest"))
    seen = copies.groupBy(*board, *key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    return seen.join(latest, board).withColumn("is_active", F.col("last_seen") == F.col("board_latest"))


def pull_calendar(pulls: DataFrame, board: list[str], day: str, ok: str, campaign: Column | None = None, source: list[str] | None = None) -> DataFrame:
    """Per board and day: whether a try succeeded, and whether it is a baseline pull.

    A baseline pull is the board's first success. Where ``campaign`` holds (sources asked by
    query, whose first round runs over several days) it is any success of the first successful
    week of the ``source``.
    """
    days = pulls.groupBy(*board, day).agg((F.count_if(F.col(ok)) > 0).alias("is_successful"), F.count(F.lit(1)).alias("tries"))
    done = F.when(F.col("is_successful"), F.col(day))
    first = F.col(day) == F.min(done).over(W.partitionBy(*board))
    if campaign is not None:
        first = F.when(campaign, week_start(F.col(day)) == F.min(week_start(done)).over(W.partitionBy(*(source or board[:1])))).otherwise(first)
    return days.withColumn("is_baseline", F.coalesce(F.col("is_successful") & first, F.lit(False)))


def missed_pulls(listings: DataFrame, calendar: DataFrame, board: list[str], key: list[str], day: str, last_seen: str, misses: int = 1) -> DataFrame:
    """Successful pulls of a listing's board after it was last seen, and the day it disappeared.

    A range join with equi keys: per board the successful days are one sorted array (bounded
    by the days of the campaign), so each listing stays one row.
    """
    days = calendar.where("is_successful").groupBy(*board).agg(F.sort_array(F.collect_set(day)).alias("_days"))
    out = listings.join(days, board, "left").withColumn("_later", F.filter(F.coalesce("_days", F.array().cast("array<date>")), lambda d: d > F.col(last_seen)))
    out = out.withColumn("missed_pulls", F.size("_later"))
    gone = F.col("missed_pulls") >= misses
    return out.withColumn("is_disappeared", gone).withColumn("disappeared_date", F.when(gone, F.array_min("_later"))).drop("_days", "_later")


def listing_lifecycle(listings: DataFrame, calendar: DataFrame, board: list[str], day: str, watched: Column, active: str = "is_active", first: str = "first_seen_date", last: str = "last_seen_date", misses: int = 1) -> DataFrame:
    """Evidence of each listing's life, from the calendar of its own board's pulls.

    Adds ``is_baseline`` (first seen in a baseline pull), ``board_latest_pull``, and for
    ``watched`` listings (those of boards pulled in full; null for others) ``pulls_missed``,
    ``is_disappeared``: its board's latest pull lacks it (``active`` is false, not unknown) and
    ``misses`` successful pulls came after its last sighting, ``disappeared_date``, and
    ``last_evidence_date``: none once disappeared, else the board's latest successful pull. Of
    others the last sighting is the last evidence. A board's days are one sorted array
    (bounded by the days of the campaign), so each listing stays one row.
    """
    days = calendar.groupBy(*board).agg(F.sort_array(F.collect_set(F.when(F.col("is_successful"), F.col(day)))).alias("_days"), F.collect_set(F.when(F.col("is_baseline"), F.col(day))).alias("_base"))
    none = F.array().cast("array<date>")
    rows = listings.join(days, board, "left").withColumn("_later", F.filter(F.coalesce("_days", none), lambda d: d > F.col(last)))
    missed = F.when(watched, F.size("_later"))
    gone = F.coalesce(watched & ~F.col(active) & (F.size("_later") >= misses), F.lit(False))
    latest = F.array_max("_days")
    evidence = F.when(gone, F.lit(None)).when(watched, F.greatest(F.col(last), F.coalesce(latest, F.col(last)))).otherwise(F.col(last))
    out = rows.withColumn("is_baseline", F.coalesce(F.array_contains(F.coalesce("_base", none), F.col(first)), F.lit(False))).withColumn("board_latest_pull", latest).withColumn("pulls_missed", missed)
    return out.withColumn("is_disappeared", F.when(watched, gone)).withColumn("disappeared_date", F.when(gone, F.array_min("_later"))).withColumn("last_evidence_date", evidence).drop("_days", "_base", "_later")


def job_lifecycle(jobs: DataFrame, as_of: Column, window: int = 7) -> DataFrame:
    """Status and dates of jobs, from what their listings say together.

    ``jobs``: listings_watched, listings_gone, is_baseline, first_seen_date, posting_date,
    last_gone_date, last_evidence_date. A job disappears with its last watched listing; one
    without watched listings is unknown. It has an opening date unless it stood in a baseline
    pull or was never watched.
    """
    status = F.when(F.col("listings_watched") == 0, "unknown").when(F.col("listings_gone") == F.col("listings_watched"), "disappeared").otherwise("open")
    gone = F.col("lifecycle_status") == "disappeared"
    out = jobs.withColumn("lifecycle_status", status)
    out = out.withColumn("opening_date", F.when(~F.coalesce("is_baseline", F.lit(False)) & (F.col("listings_watched") > 0), F.col("first_seen_date"))).withColumn("disappeared_date", F.when(gone, F.col("last_gone_date")))
    out = out.withColumn("open_until_date", open_until(F.col("last_evidence_date"), F.col("disappeared_date"), as_of, window))
    out = out.withColumn("days_listed", F.when(gone, F.datediff("disappeared_date", F.coalesce("posting_date", "first_seen_date"))))
    return out.withColumn("days_listed_basis", F.when(gone, F.when(F.col("posting_date").isNotNull(), "posted").otherwise("first_seen"))).withColumn("is_censored", ~gone)


def open_until(last_evidence: Column, disappeared: Column, as_of: Column, window: int = 7) -> Column:
    """The day before a listing disappeared, else its last evidence plus a window, at most ``as_of``."""
    return F.coalesce(F.date_sub(disappeared, 1), F.least(as_of, F.date_add(last_evidence, window)))


def collapsed_pulls(counts: DataFrame, board: list[str], day: str, n: str, ratio: float = 0.5, least: int = 10) -> DataFrame:
    """Boards whose latest pull holds less than a share of the one before."""
    w = W.partitionBy(*board).orderBy(day)
    out = counts.withColumn("previous", F.lag(n).over(w)).withColumn("_last", F.row_number().over(W.partitionBy(*board).orderBy(F.desc(day))))
    return out.where((F.col("_last") == 1) & (F.col("previous") >= least) & (F.col(n) < ratio * F.col("previous"))).drop("_last")


def week_coverage(pulls: DataFrame, board: list[str], week: str, day: str) -> DataFrame:
    """Per week: boards expected (first pulled by the week's end), boards pulled, full or not."""
    first = pulls.groupBy(*board).agg(F.min(day).alias("_first"))
    weeks = pulls.groupBy(week).agg(F.countDistinct(*board).alias("boards_pulled"))
    starts = first.groupBy("_first").agg(F.count(F.lit(1)).alias("_n"))
    expected = weeks.select(week).join(starts, F.col("_first") <= F.date_add(F.col(week), 6)).groupBy(week).agg(F.sum("_n").alias("boards_expected"))
    return weeks.join(expected, week).withColumn("is_full_pull", F.col("boards_pulled") == F.col("boards_expected"))
