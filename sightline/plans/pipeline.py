"""From landed files to a star schema: one lazy graph per step, materialised between steps.

Steps are run in order by :func:`run`; each reads the tables before it and writes its own, so
a run can stop, resume at any step, or be planned without running (``dry_run``).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.config import Config
from sightline.functions import text
from sightline.functions.dates import business_date
from sightline.functions.keys import surrogate_key
from sightline.operators import dictionary, lifecycle, matching, survivorship
from sightline.operators.semistructured import at, explode_array
from sightline.operators.units import quantity
from sightline.operators.windows import latest_snapshot
from sightline.plans import star
from sightline.sources.landing import LAYOUTS, check_sources, landed_files, scan

#: Path of each column in a source's posting; columns that a source lacks are null.
COLUMNS = ["source_job_id", "title", "company", "location", "city", "region", "country", "employment_type", "experience", "posted", "job_url", "apply_url", "description", "publisher", "salary_text", "workplace", "remote"]
FIELDS: dict[str, dict[str, str]] = {
    "ashby": {"source_job_id": "$.id", "title": "$.title", "location": "$.location", "city": "$.address.postalAddress.addressLocality", "region": "$.address.postalAddress.addressRegion", "country": "$.address.postalAddress.addressCountry", "employment_type": "$.employmentType", "workplace": "$.workplaceType", "remote": "$.isRemote", "posted": "$.publishedAt", "job_url": "$.jobUrl", "apply_url": "$.applyUrl", "description": "$.descriptionPlain"},
    "greenhouse": {"source_job_id": "$.id", "title": "$.title", "company": "$.company_name", "location": "$.location.name", "posted": "$.first_published", "job_url": "$.absolute_url", "description": "$.content"},
    "smartrecruiters": {"source_job_id": "$.id", "title": "$.name", "company": "$.company.name", "location": "$.location.fullLocation", "city": "$.location.city", "region": "$.location.region", "country": "$.location.country", "employment_type": "$.typeOfEmployment.label", "experience": "$.experienceLevel.label", "remote": "$.location.remote", "posted": "$.releasedDate", "description": "$.jobAd.sections.jobDescription.text"},
    "workable": {"source_job_id": "$.shortcode", "title": "$.title", "city": "$.city", "region": "$.state", "country": "$.country", "employment_type": "$.employment_type", "experience": "$.experience", "remote": "$.telecommuting", "posted": "$.published_on", "job_url": "$.url", "apply_url": "$.application_url", "description": "$.description"},
    "jooble": {"source_job_id": "$.id", "title": "$.title", "company": "$.company", "location": "$.location", "job_url": "$.link", "description": "$.snippet", "publisher": "$.source", "salary_text": "$.salary"},
    "jsearch": {"source_job_id": "$.job_uid", "title": "$.job_title", "company": "$.employer_name", "location": "$.job_location", "city": "$.job_city", "region": "$.job_state", "country": "$.job_country", "employment_type": "$.job_employment_type", "remote": "$.job_is_remote", "posted": "$.job_posted_at_datetime_utc", "job_url": "$.job_google_link", "apply_url": "$.job_apply_link", "description": "$.job_description", "publisher": "$.job_publisher", "salary_text": "$.job_salary_string"},
}
#: Columns beside the id that make a posting of a source a listing of its own.
EXTRA_KEY = {"workable": ["city"]}


def stage(raw: DataFrame, source: str, scope: Column | None = None) -> DataFrame:
    """Listings of one source: its postings flattened, in scope, latest copy first, all copies observed.

    An aggregator's page counts only with HTTP 200. ``is_active`` compares with the latest
    landed file of the listing's own board, whatever it held.
    """
    path, envelope = LAYOUTS[check_sources([source])[0]]
    rows = raw.select("raw_data", "file_name", "loaded_at", "board", "ingest_date")
    if envelope:
        rows = rows.where(at(F.col("raw_data"), "$.http_status", "int") == 200)
        seen = F.coalesce(at(F.col("raw_data"), "$.ingested_at", "timestamp"), F.to_timestamp("ingest_date"))
        rows = rows.select(F.try_parse_json(at(F.col("raw_data"), "$.response_raw")).alias("raw_data"), "file_name", "loaded_at", "board", "ingest_date", seen.alias("seen_at"))
    else:
        rows = rows.withColumn("seen_at", F.to_timestamp("ingest_date"))
    latest = rows.groupBy("board").agg(F.max("ingest_date").alias("board_latest"))
    jobs = explode_array(rows, "raw_data", path)
    extracted = [text.clean(at(F.col("item"), FIELDS[source][c])).alias(c) if c in FIELDS[source] else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    jobs = jobs.select("board", "ingest_date", "file_name", "loaded_at", "seen_at", "pos", *extracted).where("source_job_id is not null")
    jobs = jobs.withColumn("company", F.coalesce("company", "board")).withColumn("location", F.coalesce("location", F.nullif(F.concat_ws(", ", "city", "region", "country"), F.lit(""))))
    if scope is not None:
        jobs = jobs.where(scope)
    key = ["source_job_id", *EXTRA_KEY.get(source, [])]
    order = [F.desc("seen_at"), F.desc("loaded_at"), F.desc("file_name") if envelope else F.asc("file_name"), F.asc("pos")]
    out = latest_snapshot(jobs, key, order, "seen_at").join(latest, "board")
    active = F.lit(None).cast("boolean") if envelope else F.col("ingest_date") == F.col("board_latest")
    return out.withColumn("is_active", active).withColumn("board", F.lit(source) if envelope else F.col("board")).withColumn("source_name", F.lit(source)).withColumn("source_type", F.lit("Aggregator" if envelope else "ATS")).withColumn("source_record_sk", surrogate_key(F.lit(source), *map(F.col, key))).drop("board_latest", "pos")


def standardize(staged: list[DataFrame], places: DataFrame, aliases: DataFrame, priority: dict[str, int], cfg: Config = Config(), categories: DataFrame | None = None, levels: DataFrame | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """One table of listings: text keys, company, place, dates, workplace, level, category, pay; every staged row is kept.

    ``categories`` (keyword, job_category, priority) and ``levels`` (keyword, experience_level,
    priority) are dictionaries of title words, of which a row without label blocks those after
    it; ``rates`` (units of SAR by currency) turns stated pay into SAR a month.
    """
    rows = reduce(DataFrame.unionByName, staged)
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]) if priority else None
    key = text.normalize_company(F.col("company"))
    rows = rows.withColumn("_alias", key).join(aliases.select(F.col("alias").alias("_a"), "company_std").dropDuplicates(["_a"]), F.col("_alias") == F.col("_a"), "left").drop("_a")
    name = F.when(F.col("_alias").isNull() | (F.col("company_std") == "Unknown"), "Unknown").otherwise(F.coalesce("company_std", F.trim("company")))
    rows = rows.withColumn("company_name", name).withColumn("company_norm", F.when(name != "Unknown", text.normalize_company(name)))
    rows = rows.withColumn("title_norm", text.normalize_title(F.col("title"))).withColumn("employment_type", text.normalize_employment_type(F.col("employment_type"))).withColumn("description_text", text.strip_html(F.col("description")))
    rows = rows.withColumn("publisher_key", F.when(F.col("source_type") == "ATS", F.concat_ws(":", "source_name", "board")).otherwise(text.publisher_key(F.col("publisher"), F.col("source_name"))))
    rows = rows.withColumn("source_priority", F.coalesce(F.try_element_at(rank, F.col("source_name")), F.lit(99)) if rank is not None else F.lit(99)).withColumn("first_seen_date", business_date(F.col("first_seen"), cfg.business_timezone)).withColumn("last_seen_date", business_date(F.col("last_seen"), cfg.business_timezone))
    remote = F.col("remote").try_cast("boolean")
    rows = rows.withColumn("workplace_type", text.workplace_type(F.col("workplace"), remote)).withColumn("remote_status", text.remote_status(F.col("workplace_type"), remote))
    rows = rows.withColumn("stated_level", F.coalesce(F.nullif(F.col("experience"), F.lit("Not Applicable")), F.lit("Unknown")))
    rows = _tagged(rows, categories, "job_category")
    rows = _tagged(rows, levels, "experience_level")
    stated = F.col("stated_level") != "Unknown"
    level = F.when(stated, F.col("stated_level")).otherwise(F.coalesce("experience_level", F.lit("Unknown")))
    basis = F.when(stated, "source").when(F.col("experience_level").isNotNull(), "title").otherwise("unknown")
    rows = rows.withColumn("experience_level_basis", basis).withColumn("experience_level", level)
    category = F.when(F.col("title_norm").isNull(), "Unknown").otherwise(F.coalesce("job_category", F.when(F.col("job_category_ruled"), F.lit("Unknown")), F.lit("Other")))
    rows = rows.withColumn("job_category", category).drop("stated_level", "job_category_ruled", "experience_level_ruled", "workplace", "remote")
    per_year = {"hour": 2496.0, "day": 312.0, "week": 52.0, "month": 12.0, "year": 1.0}
    known_rates = rates or {"SAR": 1.0, "USD": 3.75}
    pay = quantity(F.col("salary_text"), known_rates, per_year)
    factor = F.create_map(*[F.lit(x) for kv in per_year.items() for x in kv])
    rate = F.create_map(*[F.lit(x) for kv in known_rates.items() for x in kv])
    rows = rows.withColumn("_pay", pay).withColumn("salary_is_parsed", F.when(F.col("salary_text").isNotNull(), F.col("_pay.low").isNotNull() & F.col("_pay.root").isNotNull() & F.col("_pay.period").isNotNull()))
    monthly = lambda c: F.when(F.col("salary_is_parsed"), F.round(F.col(f"_pay.{c}").cast("double") * F.try_element_at(factor, F.col("_pay.period")) * F.try_element_at(rate, F.col("_pay.root")) / 12))
    rows = rows.withColumn("salary_currency", F.col("_pay.root")).withColumn("salary_period", F.col("_pay.period")).withColumn("salary_min_sar_month", monthly("low")).withColumn("salary_max_sar_month", monthly("high")).drop("_pay")
    where = rows.select("source_record_sk", text.normalize_text(F.col("city")).alias("c"), text.normalize_text(F.col("location")).alias("x"))
    placed = dictionary.resolve_place(where, "source_record_sk", "c", "x", places).withColumnRenamed("city", "city_std").withColumnRenamed("region", "region_std")
    return rows.join(placed, "source_record_sk").withColumn("posting_sk", surrogate_key(F.col("source_name"), F.col("source_job_id"))).drop("_alias", "company_std", "description")


def _tagged(rows: DataFrame, rules: DataFrame | None, label: str) -> DataFrame:
    """Adds the label of a title's first rule, and whether any rule held."""
    if rules is None:
        return rows.withColumn(label, F.lit(None).cast("string")).withColumn(f"{label}_ruled", F.lit(False))
    hits = dictionary.ngram_join(rows.select("source_record_sk", "title_norm").distinct(), ["source_record_sk"], "title_norm", rules, "keyword")
    tags = dictionary.tag_by_priority(hits, ["source_record_sk"], "priority", "keyword", label).withColumn(f"{label}_ruled", F.lit(True))
    return rows.join(tags, "source_record_sk", "left").withColumn(f"{label}_ruled", F.coalesce(f"{label}_ruled", F.lit(False)))


def match(listings: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(source_record_sk, job_sk, match_tier, is_representative): exact groups, then mutual-best merges."""
    rows = listings.select("source_record_sk", "posting_sk", "title_norm", "company_norm", "city_std", "region_std", "location_level", "publisher_key", "source_name", "source_priority", "first_seen")
    able = F.col("title_norm").isNotNull() & F.col("company_norm").isNotNull() & F.col("city_std").isNotNull()
    grouped = matching.exact_groups(rows, ["title_norm", "company_norm", "city_std"], ["publisher_key", "source_name"], [F.asc("first_seen"), F.asc("posting_sk")])
    grouped = grouped.withColumn("match_group", F.when(able, F.col("match_group")).otherwise(F.md5(F.concat_ws("|", "posting_sk", "city_std", "region_std", "location_level"))))
    groups = grouped.where(able).groupBy("match_group", "title_norm", "company_norm", "city_std").agg(F.min("source_priority").alias("p"), F.min("first_seen").alias("first_seen")).withColumn("signature", text.level_signature(F.col("title_norm")))
    pairs = matching.blocked_pairs(groups, "match_group", ["company_norm", "city_std", "signature"], ["title_norm", "first_seen"]).where("title_norm_a <> title_norm_b").withColumn("gap", F.abs(F.datediff("first_seen_a", "first_seen_b")))
    pairs = matching.veto_shared(pairs, "match_group", grouped.withColumn("_p", F.concat_ws("|", "publisher_key", "source_name")), "match_group", "_p")
    scored = matching.score_pairs(pairs, "title_norm", with_jaro_winkler=cfg.fuzzy_match_function == "jaro_winkler")
    merged = matching.mutual_best(scored, "match_group", cfg.fuzzy_match_function, cfg.fuzzy_match_threshold, gap="gap")
    to = merged.select(F.col("match_group_b").alias("match_group"), F.col("match_group_a").alias("_into")).unionByName(merged.select(F.col("match_group_a").alias("match_group"), F.col("match_group_a").alias("_into")))
    final = grouped.join(to, "match_group", "left").withColumn("_g", F.coalesce("_into", "match_group"))
    w = W.partitionBy("_g")
    job = F.first("source_record_sk").over(w.orderBy("first_seen", "source_record_sk"))
    tier = F.when(F.col("_into").isNotNull(), "fuzzy").when(F.min("posting_sk").over(w) != F.max("posting_sk").over(w), "exact").otherwise("single")
    out = final.withColumn("job_sk", job).withColumn("match_tier", tier)
    return survivorship.representative(out, ["job_sk"], [F.asc("source_priority"), F.asc("first_seen"), F.asc("source_record_sk")]).select("source_record_sk", "job_sk", "match_tier", "is_representative")


def openings(listings: DataFrame, jobs: DataFrame, calendar: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per job: surviving values, observation window and lifecycle, in a single aggregate.

    Workplace and remote status come together, from the first listing that knows the latter;
    a level stated by a source goes before one read from a title; all pay fields are those of
    the first listing with a pay text; an employer board's posting date goes before others.
    """
    ats = F.col("source_type") == "ATS"
    lived = lifecycle.listing_lifecycle(listings, calendar, ["source_name", "board"], "pull_date", ats, misses=cfg.disappearance_misses)
    rows = lived.join(jobs, "source_record_sk").withColumn("_posted", F.to_date(F.try_to_timestamp("posted")))
    rank = F.struct("source_priority", "first_seen", "source_record_sk")
    first = lambda c, known=None, by=rank: survivorship.first_known(F.col(c), by, known).alias(c)
    stated = F.col("experience_level") != "Unknown"
    by_basis = F.struct(F.col("experience_level_basis") != "source", rank)
    remote, paid = F.col("remote_status") != "Unknown", F.col("salary_text").isNotNull()
    out = rows.groupBy("job_sk").agg(
        *[F.min_by(c, rank).alias(c) for c in ("posting_sk", "title", "title_norm", "company_name", "city_std", "region_std", "location_level", "source_name", "job_category", "job_url", "description_text")], first("employment_type"),
        *[F.coalesce(first(c, stated, by_basis), F.lit(none)).alias(c) for c, none in (("experience_level", "Unknown"), ("experience_level_basis", "unknown"))], *[F.coalesce(first(c, remote), F.lit("Unknown")).alias(c) for c in ("workplace_type", "remote_status")],
        *[first(c, paid) for c in ("salary_text", "salary_is_parsed", "salary_currency", "salary_period", "salary_min_sar_month", "salary_max_sar_month")], survivorship.prefer(F.col("_posted"), ats).alias("posting_date"),
        F.max("match_tier").alias("match_tier"), F.min("first_seen_date").alias("first_seen_date"), F.max("last_seen_date").alias("last_seen_date"), F.count(F.lit(1)).alias("listing_count"), F.countDistinct("source_name").alias("source_count"), F.sum("copies_landed").alias("copies_landed"), F.array_sort(F.collect_set("source_name")).alias("sources"),
        F.bool_or("is_baseline").alias("is_baseline"), F.count_if(ats).alias("listings_watched"), F.count_if(ats & F.col("is_disappeared")).alias("listings_gone"), F.max(F.when(ats, F.col("disappeared_date"))).alias("last_gone_date"), F.max("last_evidence_date").alias("last_evidence_date"),
    )
    as_of = calendar.where("is_successful").agg(F.max("pull_date")).first()[0]
    return lifecycle.job_lifecycle(out, F.lit(as_of).cast("date"), cfg.recent_window_days).drop("last_gone_date")


def tag_skills(listings: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """(job_sk, skill_name, matched_in): skills (keyword, skill_name) named by any listing of a job."""
    both = F.array(F.struct(F.col("title_norm").alias("v"), F.lit(True).alias("in_title")), F.struct(text.normalize_text(F.col("description_text")).alias("v"), F.lit(False).alias("in_title")))
    rows = listings.select("source_record_sk", F.inline(both)).join(jobs.select("source_record_sk", "job_sk"), "source_record_sk").select("job_sk", "v", "in_title").distinct()
    return dictionary.tag_all(dictionary.ngram_join(rows, ["job_sk", "in_title"], "v", skills, "keyword"), ["job_sk"], "skill_name", F.col("in_title"))


def marts(jobs: DataFrame, skills: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dimensions with their Unknown member, the fact of one row per job, and the bridge to skills."""
    known = jobs.withColumn("employment_type", F.coalesce("employment_type", F.lit("Unknown")))
    flags = ["employment_type", "workplace_type", "experience_level", "experience_level_basis", "match_tier"]
    company = star.with_unknown(star.dimension(known.where("company_name <> 'Unknown'"), "company_sk", ["company_name"], ["company_name"]), {"company_sk": "-1", "company_name": "Unknown"})
    role = star.with_unknown(star.dimension(known.where("job_category <> 'Unknown'"), "role_sk", ["job_category"], ["job_category"]), {"role_sk": "-1", "job_category": "Unknown"})
    posting = star.dimension(known.withColumn("posting_key", F.col("posting_sk")), "posting_dim_sk", ["posting_key"], ["first_seen_date", "job_sk", "posting_sk", "title", "job_url"]).drop("posting_dim_sk")
    span = known.agg(F.min(F.least("posting_date", "first_seen_date")).alias("a"), F.max(F.greatest("last_seen_date", "open_until_date", "disappeared_date")).alias("b")).first()
    dates = {"posting_date_sk": "posting_date", "first_seen_date_sk": "first_seen_date", "last_seen_date_sk": "last_seen_date", "opening_date_sk": "opening_date", "disappeared_date_sk": "disappeared_date", "open_until_date_sk": "open_until_date"}
    measures = ["job_sk", "posting_sk", "lifecycle_status", "is_censored", "days_listed", "days_listed_basis", "listing_count", "source_count", "copies_landed", "salary_text", "salary_is_parsed", "salary_currency", "salary_period", "salary_min_sar_month", "salary_max_sar_month"]
    counts = [F.array_contains("sources", s).cast("int").alias(f"on_{s}") for s in FIELDS]
    keys = {"company_sk": ["company_name"], "location_sk": ["city_std", "region_std", "location_level"], "role_sk": ["job_category"], "source_sk": ["source_name"], "job_attributes_sk": flags}
    fact = star.fact(known, keys, dates, [*measures, *counts, F.lit(1).alias("job_count")], {"company_sk": F.col("company_name") == "Unknown", "role_sk": F.col("job_category") == "Unknown"})
    out = {
        "dim_company": company, "dim_location": star.dimension(known, "location_sk", keys["location_sk"], keys["location_sk"]), "dim_role": role, "dim_source": star.dimension(known, "source_sk", ["source_name"], ["source_name"]), "dim_job_attributes": star.junk_dimension(known, "job_attributes_sk", flags),
        "dim_job_posting": posting, "fct_jobs": fact,
    }
    if span["a"] is not None:
        out["dim_date"] = star.date_dimension(jobs.sparkSession, str(span["a"]), str(span["b"]))
    if skills is not None:
        out["dim_skill"] = star.dimension(skills, "skill_sk", ["skill_name"], ["skill_name"])
        out["bridge_job_skill"] = skills.select("job_sk", surrogate_key(F.col("skill_name")).alias("skill_sk"), "matched_in")
    return out


STEPS = ("stage", "listings", "match", "openings", "marts")


def run(spark: SparkSession, raw: str, out: str, places: DataFrame, aliases: DataFrame, priority: dict[str, int], sources: list[str] | None = None, steps: tuple[str, ...] = STEPS, dry_run: bool = False, cfg: Config = Config(), categories: DataFrame | None = None, levels: DataFrame | None = None, skills: DataFrame | None = None) -> list[tuple[str, str, float]]:
    """Runs the steps in order; the log has (step, status, seconds). The first failure stops the run."""
    names = check_sources(sources or list(FIELDS))
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown step: {', '.join(sorted(unknown))}")
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")

    def do_stage() -> None:
        files = []
        for s in names:
            landed = scan(spark, f"{raw}/{s}")
            write(stage(landed, s), f"stg_{s}")
            files.append(landed_files(landed, s, cfg.business_timezone))
        asked = F.col("source_name").isin([s for s in names if LAYOUTS[s][1]])
        write(lifecycle.pull_calendar(reduce(DataFrame.unionByName, files).withColumnRenamed("ingest_date", "pull_date"), ["source_name", "board"], "pull_date", "is_successful", campaign=asked, source=["source_name"]), "pulls")

    todo: dict[str, Callable[[], None]] = {
        "stage": do_stage,
        "listings": lambda: write(standardize([read(f"stg_{s}") for s in names], places, aliases, priority, cfg, categories, levels), "listings"),
        "match": lambda: write(match(read("listings"), cfg), "jobs_matched"),
        "openings": lambda: write(openings(read("listings"), read("jobs_matched"), read("pulls"), cfg), "openings"),
        "marts": lambda: [write(df, n) for n, df in marts(read("openings"), None if skills is None else tag_skills(read("listings"), read("jobs_matched"), skills)).items()] and None,
    }
    log: list[tuple[str, str, float]] = []
    for step in STEPS:
        if step not in steps:
            continue
        began = time.monotonic()
        if dry_run:
            log.append((step, "planned", 0.0))
            continue
        try:
            todo[step]()
            log.append((step, "ok", time.monotonic() - began))
        except Exception:
            log.append((step, "failed", time.monotonic() - began))
            raise
    return log
