"""From observed listings to jobs and the questions asked of them, as queries with their SQL.

The chain of the pipeline over the test tables: the lifecycle of each listing from the
calendar of pulls, one row per job with surviving values and lifecycle, dimensions, fact
and bridge, questions on these, and the invariants that must hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import dates, text
from sightline.functions.keys import surrogate_key
from sightline.functions.similarity import jaccard
from sightline.operators import dictionary, lifecycle, survivorship, windows
from sightline.plans import star
from sightline.plans.catalogue import _NORM, _WORDS_SQL, _remove, _words
from sightline.session import bounded_broadcast, cut_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its name with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# --- lifecycle of listings and jobs -----------------------------------------------------------

_L = "l as (select distinct * exclude (loaded_at) from int_job_listings)"
_CAL = """c as (select source_name, board, pull_date, count(*) filter (is_successful) > 0 as ok from int_board_pulls group by all),
cal as (select *, coalesce(ok and pull_date = min(case when ok then pull_date end) over (partition by source_name, board), false) as base from c)"""
_LL = f"""{_L}, {_CAL}, bc as (select source_name, board, max(pull_date) as latest from cal where ok group by all),
mp as (select l.source_record_sk, count(*) as n, min(p.pull_date) as first_missed from l join cal p on p.source_name = l.source_name and p.board = l.board and p.ok and p.pull_date > l.last_seen_date where l.source_type = 'ATS' group by 1),
ll as (select l.* exclude (is_disappeared), b.pull_date is not null as is_baseline, bc.latest as board_latest_pull, case when source_type = 'ATS' then coalesce(mp.n, 0) end as pulls_missed, case when source_type = 'ATS' then coalesce(not is_active and coalesce(mp.n, 0) >= 1, false) end as is_disappeared,
case when source_type = 'ATS' and not is_active and coalesce(mp.n, 0) >= 1 then mp.first_missed end as disappeared_date, case when source_type = 'ATS' and not is_active and coalesce(mp.n, 0) >= 1 then null when source_type = 'ATS' then greatest(last_seen_date, coalesce(bc.latest, last_seen_date)) else last_seen_date end as last_evidence_date
from l left join bc on bc.source_name = l.source_name and bc.board = l.board left join cal b on b.source_name = l.source_name and b.board = l.board and b.pull_date = l.first_seen_date and b.base left join mp on mp.source_record_sk = l.source_record_sk)"""
_EVIDENCE = ["source_record_sk", "is_baseline", "board_latest_pull", "pulls_missed", "is_disappeared", "disappeared_date", "last_evidence_date"]


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """The listings, each once, with the evidence of their life."""
    rows = table(spark, d, "int_job_listings").drop("loaded_at", "is_disappeared").distinct()
    calendar = lifecycle.pull_calendar(table(spark, d, "int_board_pulls"), ["source_name", "board"], "pull_date", "is_successful")
    return lifecycle.listing_lifecycle(rows, calendar, ["source_name", "board"], "pull_date", F.col("source_type") == "ATS")


@query(f"with {_LL} select {', '.join(_EVIDENCE)} from ll")
def listing_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select(*[F.col(c).cast("long") if c == "pulls_missed" else F.col(c) for c in _EVIDENCE])


_KNOWN = ["employment_type", "workplace_type", "experience_level", "salary_text"]
_JOB = f"""{_LL}, m as (select distinct job_sk, source_record_sk, match_tier from int_jobs_matched),
r as (select ll.*, coalesce(m.job_sk, ll.source_record_sk) as job_sk, coalesce(m.match_tier, 'single') as match_tier, row_number() over (partition by coalesce(m.job_sk, ll.source_record_sk) order by coalesce(source_priority, 99), first_seen_at, ll.source_record_sk) as rank from ll left join m using (source_record_sk)),
a as (select job_sk, {', '.join(f"max({c}) filter (rank = 1) as {c}" for c in ('posting_sk', 'company_name', 'city_std', 'region_std', 'title_norm', 'source_name', 'description_basis'))}, {', '.join(f"coalesce(arg_min({c}, rank) filter ({c} is not null and {c} <> 'Unknown'), 'Unknown') as {c}" for c in _KNOWN[:3])}, arg_min(salary_text, rank) filter (salary_text is not null) as salary_text,
coalesce(min(posting_date) filter (source_type = 'ATS'), min(posting_date)) as posting_date, min(first_seen_date) as first_seen_date, max(last_seen_date) as last_seen_date, bool_or(is_baseline) as is_baseline, count(*) filter (source_type = 'ATS') as listings_watched, count(*) filter (source_type = 'ATS' and is_disappeared) as listings_gone, max(case when source_type = 'ATS' then disappeared_date end) as last_gone_date, max(last_evidence_date) as last_evidence_date,
case when count(*) filter (match_tier = 'fuzzy') > 0 then 'fuzzy' when count(distinct posting_sk) > 1 then 'exact' else 'single' end as match_tier, count(*) as listing_count, sum(copies_landed)::bigint as copies_landed, count(distinct source_name) as source_count from r group by job_sk),
o as (select max(pull_date) as as_of from int_board_pulls where is_successful), s as (select a.*, case when listings_watched = 0 then 'unknown' when listings_gone = listings_watched then 'disappeared' else 'open' end as lifecycle_status from a),
j as (select s.* exclude (last_gone_date), case when not is_baseline and listings_watched > 0 then first_seen_date end as opening_date, case when lifecycle_status = 'disappeared' then last_gone_date end as disappeared_date, case when lifecycle_status = 'disappeared' then last_gone_date - 1 else least(as_of, last_evidence_date + 7) end as open_until_date, case when lifecycle_status = 'disappeared' then last_gone_date - coalesce(posting_date, first_seen_date) end as days_listed,
case when lifecycle_status = 'disappeared' then case when posting_date is not null then 'posted' else 'first_seen' end end as days_listed_basis, lifecycle_status <> 'disappeared' as is_censored from s, o)"""
_SURVIVE = ["job_sk", "posting_sk", "company_name", "city_std", "region_std", "title_norm", "source_name", "description_basis", *_KNOWN, "posting_date", "first_seen_date", "last_seen_date", "match_tier", "listing_count", "copies_landed", "source_count"]
_LIFE = ["job_sk", "is_baseline", "listings_watched", "listings_gone", "lifecycle_status", "opening_date", "disappeared_date", "open_until_date", "days_listed", "days_listed_basis", "is_censored"]


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its job; a listing that no build has matched is a job of its own."""
    matched = table(spark, d, "int_jobs_matched").select(F.col("job_sk").alias("_job"), "source_record_sk", "match_tier").distinct()
    rows = _listings(spark, d).join(matched, "source_record_sk", "left")
    return rows.withColumn("job_sk", F.coalesce("_job", "source_record_sk")).withColumn("match_tier", F.coalesce("match_tier", F.lit("single"))).drop("_job")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row per job in one aggregate: no window gathers a job's listings."""
    rank, ats = F.struct(F.coalesce("source_priority", F.lit(99)), "first_seen_at", "source_record_sk"), F.col("source_type") == "ATS"
    known = lambda c: F.coalesce(survivorship.first_known(F.col(c), rank, F.col(c).isNotNull() & (F.col(c) != "Unknown")), F.lit("Unknown")).alias(c)
    out = _members(spark, d).groupBy("job_sk").agg(
        *[F.min_by(c, rank).alias(c) for c in _SURVIVE[1:8]], *map(known, _KNOWN[:3]), survivorship.first_known(F.col("salary_text"), rank).alias("salary_text"), survivorship.prefer(F.col("posting_date"), ats).alias("posting_date"),
        F.min("first_seen_date").alias("first_seen_date"), F.max("last_seen_date").alias("last_seen_date"), F.bool_or("is_baseline").alias("is_baseline"), F.count_if(ats).alias("listings_watched"), F.count_if(ats & F.col("is_disappeared")).alias("listings_gone"), F.max(F.when(ats, F.col("disappeared_date"))).alias("last_gone_date"), F.max("last_evidence_date").alias("last_evidence_date"),
        F.when(F.count_if(F.col("match_tier") == "fuzzy") > 0, "fuzzy").when(F.countDistinct("posting_sk") > 1, "exact").otherwise("single").alias("match_tier"), F.count(F.lit(1)).alias("listing_count"), F.sum("copies_landed").alias("copies_landed"), F.countDistinct("source_name").alias("source_count"),
    )
    as_of = table(spark, d, "int_board_pulls").where("is_successful").agg(F.max("pull_date")).first()[0]
    return lifecycle.job_lifecycle(out, F.lit(as_of).cast("date"))


@query(f"with {_JOB} select {', '.join(_SURVIVE)} from j")
def job_survivorship(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select(*_SURVIVE)


@query(f"with {_JOB} select {', '.join(_LIFE)} from j")
def job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select(*[F.col(c).cast("long") if c == "days_listed" else F.col(c) for c in _LIFE])


# --- dimensions, fact, bridge -----------------------------------------------------------------

_KEY = "md5(concat_ws('-', {}))"
_PART = "coalesce({}::varchar, '_dbt_utils_surrogate_key_null_')"
_PLACE = _KEY.format(", ".join(_PART.format(c) for c in ("city_std", "region_std")))
_ATTR = _KEY.format(", ".join(_PART.format(c) for c in ("employment_type", "workplace_type", "experience_level", "match_tier")))
_DAY = "coalesce(strftime({}, '%Y%m%d')::int, -1)"
_DATES = {"posting_date_sk": "posting_date", "first_seen_date_sk": "first_seen_date", "opening_date_sk": "opening_date", "disappeared_date_sk": "disappeared_date"}
_FACT = f"f as (select job_sk, posting_sk, case when company_name is null then '-1' else {_KEY.format(_PART.format('company_name'))} end as company_sk, {_PLACE} as location_sk, {_ATTR} as job_attributes_sk, {_KEY.format(_PART.format('source_name'))} as source_sk, {', '.join(f'{_DAY.format(c)} as {k}' for k, c in _DATES.items())}, lifecycle_status, days_listed, days_listed_basis, listing_count, source_count, 1 as job_count from j)"


@query(f"with {_JOB}, {_FACT} select * from f")
def fact_jobs(spark: SparkSession, d: str) -> DataFrame:
    keys = {"company_sk": ["company_name"], "location_sk": ["city_std", "region_std"], "job_attributes_sk": ["employment_type", "workplace_type", "experience_level", "match_tier"], "source_sk": ["source_name"]}
    return star.fact(_jobs(spark, d), keys, _DATES, ["job_sk", "posting_sk", "lifecycle_status", F.col("days_listed").cast("long").alias("days_listed"), "days_listed_basis", "listing_count", "source_count", F.lit(1).alias("job_count")], {"company_sk": F.col("company_name").isNull()})


@query(f"with {_JOB} select {_KEY.format(_PART.format('company_name'))} as company_sk, company_name, arg_min(region_std, case when region_std is null then null else printf('%012d', 1000000000 - n) || region_std end) as main_region from (select company_name, region_std, count(*) as n from j where company_name is not null group by all) group by company_name union all select '-1', 'Unknown', null")
def dim_company_with_mode(spark: SparkSession, d: str) -> DataFrame:
    counted = _jobs(spark, d).where("company_name is not null").groupBy("company_name", "region_std").agg(F.count(F.lit(1)).alias("n"))
    dim = counted.groupBy("company_name").agg(F.min_by("region_std", F.when(F.col("region_std").isNotNull(), F.struct(-F.col("n"), F.col("region_std")))).alias("main_region"))
    return star.with_unknown(dim.select(surrogate_key(F.col("company_name")).alias("company_sk"), "company_name", "main_region"), {"company_sk": "-1", "company_name": "Unknown"})


_TAGS = f"""t as (select job_sk, category, bool_or(in_title) as in_title from (select r.job_sk, category, coalesce(contains(' ' || title_norm || ' ', ' ' || word || ' '), false) as in_title from r join {_WORDS_SQL} on contains(' ' || title_norm || ' ', ' ' || word || ' ') or contains(' ' || {_NORM.format('description_text')} || ' ', ' ' || word || ' ') where category is not null) group by all)"""


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """Skills of every job, found in the title or the description of any of its listings."""
    matched = table(spark, d, "int_jobs_matched").select(F.col("job_sk").alias("_job"), "source_record_sk").distinct()
    rows = table(spark, d, "int_job_listings").select("source_record_sk", "title_norm", "description_text").distinct().join(matched, "source_record_sk", "left").withColumn("job_sk", F.coalesce("_job", "source_record_sk"))
    both = F.array(F.struct(F.col("title_norm").alias("v"), F.lit(True).alias("in_title")), F.struct(text.normalize_text(F.col("description_text")).alias("v"), F.lit(False).alias("in_title")))
    hits = dictionary.ngram_join(rows.select("job_sk", F.inline(both)).distinct(), ["job_sk", "in_title"], "v", _words(spark).where("category is not null"), "word")
    return dictionary.tag_all(hits, ["job_sk"], "category", F.col("in_title"))


@query(f"with {_JOB}, {_TAGS} select job_sk, {_KEY.format(_PART.format('category'))} as skill_sk, case when in_title then 'title' else 'description' end as matched_in from t")
def bridge_job_skill(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("job_sk", surrogate_key(F.col("category")).alias("skill_sk"), "matched_in")


# --- questions --------------------------------------------------------------------------------


@query(f"with {_JOB} select count(*) as job_openings, count(distinct posting_sk) as job_postings, sum(listing_count)::bigint as listings from j")
def q1_totals(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).agg(F.count(F.lit(1)).alias("job_openings"), F.countDistinct("posting_sk").alias("job_postings"), F.sum("listing_count").alias("listings"))


@query(f"with {_JOB} select coalesce(region_std, 'no region given') as region, count(*) as job_openings from j group by 1 order by job_openings desc")
def q2_regions(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy(F.coalesce("region_std", F.lit("no region given")).alias("region")).agg(F.count(F.lit(1)).alias("job_openings")).orderBy(F.desc("job_openings"), "region")


@query(f"with {_JOB} select city_std, region_std, count(*) as job_openings from j where city_std is not null group by city_std, region_std qualify rank() over (order by count(*) desc) <= 10")
def q2_top_cities(spark: SparkSession, d: str) -> DataFrame:
    per = cut_table(_jobs(spark, d).where("city_std is not null").groupBy("city_std", "region_std").agg(F.count(F.lit(1)).alias("job_openings")), "cities")
    return windows.top_n_with_ties(per, 10, "job_openings")


_COMPANY_KEY = _remove(_NORM.format("company_name"), text.COMPANY_NOISE)


@query(f"with {_JOB}, k as (select company_name, {_COMPANY_KEY} as key from j where company_name is not null), g as (select alias, min(company_std) as company_std, bool_or(is_recruitment_agency) as agency from seed_company_aliases group by 1) select coalesce(company_std, key) as employer, count(*) as job_openings from k left join g on key = alias where coalesce(company_std, '') <> 'Unknown' and not coalesce(agency, false) and key is not null group by 1 qualify rank() over (order by count(*) desc) <= 10")
def q3_top_employers(spark: SparkSession, d: str) -> DataFrame:
    """Employers by their alias key, without stand-ins and agencies; the key is computed before the lookup."""
    known = table(spark, d, "seed_company_aliases").groupBy("alias").agg(F.min("company_std").alias("company_std"), F.bool_or("is_recruitment_agency").alias("agency"))
    per = _jobs(spark, d).groupBy(text.normalize_company(F.col("company_name")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("key is not null")
    named = per.join(bounded_broadcast(known), F.col("key") == F.col("alias"), "left").where("coalesce(company_std, '') <> 'Unknown' and not coalesce(agency, false)")
    return windows.top_n_with_ties(cut_table(named.groupBy(F.coalesce("company_std", "key").alias("employer")).agg(F.sum("n").alias("job_openings")), "employers"), 10, "job_openings")


@query(f"with {_JOB}, h as (select job_sk, category, row_number() over (partition by job_sk order by priority, length(word) desc, word) as n from j join {_WORDS_SQL} on contains(' ' || title_norm || ' ', ' ' || word || ' ')), x as (select case when title_norm is null or h.category is null and h.job_sk is not null then 'Unknown' when h.job_sk is null then 'Other' else category end as category from j left join h on h.job_sk = j.job_sk and h.n = 1) select category, count(*) as job_openings, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct_of_jobs from x group by 1")
def q4_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category by the title's first rule; a blocking rule (no label) and a null title are Unknown, no rule is Other."""
    jobs = cut_table(_jobs(spark, d).select("job_sk", "title_norm"), "titles")
    hits = dictionary.ngram_join(jobs, ["job_sk"], "title_norm", _words(spark), "word")
    tagged = dictionary.tag_by_priority(hits, ["job_sk"], "priority", "word", "category").withColumn("ruled", F.lit(True))
    label = F.when(F.col("title_norm").isNull(), "Unknown").when(F.col("ruled").isNull(), "Other").otherwise(F.coalesce("category", F.lit("Unknown")))
    per = jobs.join(tagged, "job_sk", "left").groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("job_openings"))
    return per.withColumn("pct_of_jobs", windows.share_within(F.col("job_openings"), []))


@query(f"with {_JOB} select employment_type, count(*) as job_openings, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct_of_known, round(100.0 * sum(count(*)) over () / (select count(*) from j), 1) as known_share from j where employment_type <> 'Unknown' group by 1")
def q5_employment_types(spark: SparkSession, d: str) -> DataFrame:
    per, w = _jobs(spark, d).groupBy("employment_type").agg(F.count(F.lit(1)).alias("job_openings")), W.partitionBy(F.lit(1))
    out = per.withColumn("_all", F.sum("job_openings").over(w)).where("employment_type <> 'Unknown'").withColumn("_known", F.sum("job_openings").over(w))
    return out.select("employment_type", "job_openings", F.round(100.0 * F.col("job_openings") / F.col("_known"), 1).alias("pct_of_known"), F.round(100.0 * F.col("_known") / F.col("_all"), 1).alias("known_share"))


@query(f"with {_JOB}, y as (select region_std, experience_level, count(*) as job_openings from j where region_std is not null and experience_level <> 'Unknown' group by all) select *, round(100.0 * job_openings / sum(job_openings) over (partition by region_std), 1) as pct_of_region, sum(job_openings) over (partition by region_std)::bigint as base from y qualify sum(job_openings) over (partition by region_std) >= 20")
def q6_levels_by_region(spark: SparkSession, d: str) -> DataFrame:
    per = _jobs(spark, d).where("region_std is not null and experience_level <> 'Unknown'").groupBy("region_std", "experience_level").agg(F.count(F.lit(1)).alias("job_openings"))
    per = per.withColumn("base", F.sum("job_openings").over(W.partitionBy("region_std"))).where("base >= 20")
    return per.withColumn("pct_of_region", F.round(100.0 * F.col("job_openings") / F.col("base"), 1))


_WEEK = "({0} - (dayofweek({0}) * interval 1 day))::date"


@query(f"with {_JOB} select {_WEEK.format('opening_date')} as week_start_date, count(*) as new_openings from j where opening_date is not null group by 1")
def q7_new_openings(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).where("opening_date is not null").groupBy(dates.week_start(F.col("opening_date")).alias("week_start_date")).agg(F.count(F.lit(1)).alias("new_openings"))


@query(f"with {_JOB} select {_WEEK.format('disappeared_date')} as week_start_date, count(*) as disappeared_jobs, median(days_listed) as median_days_listed, count(*) filter (days_listed_basis = 'posted') as from_posting_date from j where lifecycle_status = 'disappeared' group by 1")
def q8_days_listed(spark: SparkSession, d: str) -> DataFrame:
    gone = cut_table(_jobs(spark, d).where("lifecycle_status = 'disappeared'").select(dates.week_start(F.col("disappeared_date")).alias("week_start_date"), F.col("days_listed").cast("double").alias("days_listed"), "days_listed_basis"), "gone")
    counts = gone.groupBy("week_start_date").agg(F.count(F.lit(1)).alias("disappeared_jobs"), F.count_if(F.col("days_listed_basis") == "posted").alias("from_posting_date"))
    return counts.join(windows.exact_median(gone, ["week_start_date"], "days_listed", "median_days_listed"), "week_start_date", "left")


@query(f"with {_JOB}, {_TAGS}, b as (select job_sk from j where description_basis = 'full') select category, count(distinct t.job_sk) as job_openings, round(100.0 * count(distinct t.job_sk) / (select count(*) from b), 1) as pct_of_full from t join b using (job_sk) group by 1")
def q9_skill_share(spark: SparkSession, d: str) -> DataFrame:
    """Many to many through the bridge; the base is counted beside the tags, so no scalar reaches the driver."""
    full = cut_table(_jobs(spark, d).where("description_basis = 'full'").select("job_sk"), "full")
    tags = _tags(spark, d).select("job_sk", "category").join(full, "job_sk", "left_semi")
    per = tags.unionByName(full.withColumn("category", F.lit(None).cast("string"))).groupBy("category").agg(F.countDistinct("job_sk").alias("job_openings"))
    base = F.max(F.when(F.col("category").isNull(), F.col("job_openings"))).over(W.partitionBy(F.lit(1)))
    return per.withColumn("pct_of_full", F.round(100.0 * F.col("job_openings") / base, 1)).where("category is not null")


# --- invariants -------------------------------------------------------------------------------


def _failures(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("rule"), "failures") for name, df in checks.items()])


_BROKEN = ["opening_date is not null and (is_baseline or listings_watched = 0)", "(lifecycle_status = 'disappeared') <> (disappeared_date is not null)", "days_listed < 0", "is_censored = (lifecycle_status = 'disappeared')", "(listings_watched = 0) <> (lifecycle_status = 'unknown')", "open_until_date is null"]


@query(f"""with {_JOB}, {_FACT} select 'fact keeps every listing' as rule, (select count(*) from (select (select sum(listing_count) from f) as a, (select count(*) from l) as b) where a <> b) as failures
union all select 'copies cover listings', (select count(*) from j where copies_landed < listing_count) union all select 'lifecycle consistent', (select count(*) from j where {' or '.join(f'coalesce({b}, false)' for b in _BROKEN)})
union all select 'one row per job', (select count(*) from (select job_sk from f group by 1 having count(*) > 1)) union all select 'exact needs two postings', (select count(*) from j where match_tier = 'exact' and listing_count < 2)""")
def invariants_of_marts(spark: SparkSession, d: str) -> DataFrame:
    jobs = cut_table(_jobs(spark, d), "jobs")
    total = jobs.select(F.col("listing_count").alias("a"), F.lit(0).alias("b")).unionByName(table(spark, d, "int_job_listings").select("source_record_sk").distinct().select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.expr(b), F.lit(False)) for b in _BROKEN])
    return _failures({
        "fact keeps every listing": total.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> b"), "copies cover listings": jobs.where("copies_landed < listing_count"), "lifecycle consistent": jobs.where(broken),
        "one row per job": jobs.groupBy("job_sk").count().where("count > 1"), "exact needs two postings": jobs.where("match_tier = 'exact' and listing_count < 2"),
    })


@query("""with m as (select distinct job_sk, source_record_sk, is_representative, listings_in_job from int_jobs_matched), f as (select distinct * from fct_jobs)
select 'one representative per job' as rule, (select count(*) from (select job_sk from m group by 1 having count(*) filter (is_representative) <> 1)) as failures union all select 'listings counted right', (select count(*) from (select job_sk from m group by 1 having count(*) <> max(listings_in_job)))
union all select 'one row per job', (select count(*) from (select job_sk from fct_jobs group by 1 having count(*) > 1)) union all select 'amounts in order', (select count(*) from f where salary_min_amount > salary_max_amount) union all select 'active has not disappeared', (select count(*) from (select distinct source_record_sk from int_job_listings where is_active and is_disappeared))
union all select 'amount without text or unit', (select count(*) from f where salary_min_amount is not null and salary_currency is null) union all select 'employer known', (select count(*) from f where company_sk = '-1')""")
def invariants_of_given_tables(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "int_jobs_matched").select("job_sk", "source_record_sk", "is_representative", "listings_in_job").distinct()
    f, per = table(spark, d, "fct_jobs"), m.groupBy("job_sk").agg(F.count_if("is_representative").alias("flagged"), F.count(F.lit(1)).alias("n"), F.max("listings_in_job").alias("said"))
    return _failures({
        "one representative per job": per.where("flagged <> 1"), "listings counted right": per.where("n <> said"), "one row per job": f.groupBy("job_sk").count().where("count > 1"), "amounts in order": f.distinct().where("salary_min_amount > salary_max_amount"),
        "active has not disappeared": table(spark, d, "int_job_listings").where("is_active and is_disappeared").select("source_record_sk").distinct(), "amount without text or unit": f.distinct().where("salary_min_amount is not null and salary_currency is null"), "employer known": f.distinct().where("company_sk = '-1'"),
    })


# --- scope, feeds, labels ---------------------------------------------------------------------

_LIKE = ["%riyadh%", "%jabal%", "% al %", "al %"]


@query(f"select source_record_sk from stg_ashby_jobs where case when nullif(trim(country_raw), '') is not null then lower(trim(country_raw)) = 'saudi arabia' else {' or '.join(f"coalesce(location_raw ilike '{p}', false) or coalesce(city_raw ilike '{p}', false)" for p in _LIKE)} end group by 1")
def scope_structured_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stg_ashby_jobs")
    return rows.where(text.in_scope(F.col("country_raw"), [F.col("location_raw"), F.col("city_raw")], "Saudi Arabia", _LIKE)).select("source_record_sk").distinct()


@query("""with s as (select distinct source_record_sk, workplace_type_raw w, is_remote r from stg_ashby_jobs) select source_record_sk, coalesce(case when lower(w) <> 'unknown' then nullif(trim(w), '') end, case when r then 'Remote' end, 'Unknown') as workplace, case lower(replace(w, '-', '')) when 'remote' then 'Remote' when 'hybrid' then 'Hybrid' when 'onsite' then 'On-site' else case when r then 'Remote' when not r then 'On-site' else 'Unknown' end end as remote_status from s""")
def workplace_and_remote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stg_ashby_jobs").select("source_record_sk", "workplace_type_raw", "is_remote").distinct()
    return rows.select("source_record_sk", text.workplace_type(F.col("workplace_type_raw"), F.col("is_remote")).alias("workplace"), text.remote_status(F.col("workplace_type_raw"), F.col("is_remote")).alias("remote_status"))


@query(r"select job_sk, regexp_extract_all(salary_text, '\d+')[1] as first_number, regexp_extract_all(salary_text, '\d+')[2] as second_number, regexp_full_match(salary_text, '[A-Z]{3} \d+ - \d+ per (hour|day|week|month|year)') as is_plain_range from (select distinct job_sk, salary_text from fct_jobs where salary_text is not null)")
def nth_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fct_jobs").where("salary_text is not null").select("job_sk", "salary_text").distinct()
    s = F.col("salary_text")
    return rows.select("job_sk", text.nth_match(s, r"\d+", 1).alias("first_number"), text.nth_match(s, r"\d+", 2).alias("second_number"), text.matches_whole(s, "[A-Z]{3} \\d+ - \\d+ per (hour|day|week|month|year)").alias("is_plain_range"))


@query("select id, 'https://jobs.example/' || board || '/' || id as apply_url from (select distinct id, board from nash)")
def url_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nash").select("id", "board").distinct().select("id", F.concat(F.lit("https://jobs.example/"), "board", F.lit("/"), "id").alias("apply_url"))


@query("select event_id, json_extract(props::json, '$')::varchar as raw from events")
def raw_subdocument(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.to_json(F.try_parse_json("props")).alias("raw"))


@query("select o_orderkey, o_orderpriority from orders order by md5(o_orderkey::varchar), o_orderkey limit 50")
def sample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample: the limit is the feature."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(50)


@query("with m as (select distinct job_sk, source_record_sk, row_number() over (partition by job_sk order by source_record_sk) = 1 as rep from (select distinct job_sk, source_record_sk from int_jobs_matched)) select a.job_sk, a.source_record_sk, b.source_record_sk as representative from m a join m b on a.job_sk = b.job_sk and b.rep and not a.rep")
def non_representatives(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "int_jobs_matched").select("job_sk", "source_record_sk").distinct()
    first = m.groupBy("job_sk").agg(F.min("source_record_sk").alias("representative"))
    return m.join(first, "job_sk").where("source_record_sk <> representative")


_PAIRS = "d as (select distinct l.source_record_sk k, m.job_sk g, lower(company_name) c, city_std t, title_norm x from int_job_listings l join (select distinct job_sk, source_record_sk from int_jobs_matched) m using (source_record_sk) where company_name is not null and city_std is not null and title_norm is not null), p as (select a.k ka, b.k kb, a.g = b.g as truth, round(100.0 * len(list_intersect(list_distinct(string_split(a.x, ' ')), list_distinct(string_split(b.x, ' ')))) / len(list_distinct(list_concat(string_split(a.x, ' '), string_split(b.x, ' ')))), 1) as score from d a join d b on a.c = b.c and a.t = b.t and a.k < b.k)"


@query(f"with {_PAIRS}, g as (select unnest([40.0, 60.0, 80.0, 100.0])::double as threshold) select threshold, count(*) filter (score >= threshold and truth) as tp, count(*) filter (score >= threshold and not truth) as fp, count(*) filter (score < threshold and truth) as fn, round(count(*) filter (score >= threshold and truth)::double / nullif(count(*) filter (score >= threshold), 0), 4) as precision, round(count(*) filter (score >= threshold and truth)::double / nullif(count(*) filter (truth), 0), 4) as recall from p, g group by 1")
def threshold_grid_on_truth(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of the title score against the given grouping, within employer and city."""
    from sightline.operators import matching

    known = table(spark, d, "int_jobs_matched").select("job_sk", "source_record_sk").distinct()
    rows = table(spark, d, "int_job_listings").select("source_record_sk", F.lower("company_name").alias("company"), "city_std", "title_norm").where("company is not null and city_std is not null and title_norm is not null").distinct().join(known, "source_record_sk")
    pairs = matching.blocked_pairs(rows, "source_record_sk", ["company", "city_std"], ["title_norm", "job_sk"])
    scored = pairs.select(jaccard(F.col("title_norm_a"), F.col("title_norm_b")).alias("score"), (F.col("job_sk_a") == F.col("job_sk_b")).alias("truth"))
    return matching.threshold_grid(scored, "score", "truth", [40.0, 60.0, 80.0, 100.0])
