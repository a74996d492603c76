import json
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from sightline.config import Config
from sightline.operators import quality
from sightline.plans import pipeline
from sightline.sources import boards, files
from sightline.sources.landing import check_sources, landed_files, missing_pages, scan, should_stop
from sightline.streaming.load import load_new_files


def land(root, source, day, name, payload):
    p = root / source / f"ingest_date={day}" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    ad = lambda i, t, loc="Riyadh": {"id": i, "title": t, "location": loc, "employmentType": "FullTime", "descriptionPlain": "text"}
    land(root, "ashby", "2026-09-01", "acme.json", {"jobs": [ad("1", "Data Engineer"), ad("2", "Sales Lead")]})
    land(root, "ashby", "2026-09-02", "acme_jobs.json", {"jobs": [ad("1", "Data Engineer"), ad("1", "Data Engineer")]})
    land(root, "ashby", "2026-09-03", "acme.json", {"error": "not found"})
    land(root, "ashby", "2026-09-01", "quiet.json", {"jobs": []})
    page = lambda jobs, status=200: {"http_status": status, "ingested_at": "2026-09-02T22:00:00Z", "response_raw": json.dumps({"jobs": jobs})}
    land(root, "jooble", "2026-09-02", "jooble__q__s__page_001.json", page([{"id": "9", "title": "Data Engineer (Urgent)", "company": "Acme Ltd", "location": "Riyadh", "source": "www.Ads.com", "salary": "SAR 9000 - 10000 per month"}, {"id": "8", "title": "Senior Data Engineer", "company": "Acme", "location": "Riyadh or Jeddah"}]))
    land(root, "jooble", "2026-09-02", "jooble__q__s__page_002.json", page([{"id": "7", "title": "x"}], 429))
    land(root, "jooble", "2026-09-02", "jooble__q__s__page_003.json", "{broken")
    return root


def test_run_from_files_to_marts(spark, raw, tmp_path):
    places = spark.createDataFrame([("riyadh", "Riyadh", "Riyadh Region"), ("jeddah", "Jeddah", "Makkah")], "alias string, city_std string, region_std string")
    aliases = spark.createDataFrame([("acme", "Acme")], "alias string, company_std string")
    out = str(tmp_path / "out")
    args = (spark, str(raw), out, places, aliases, {"ashby": 1, "jooble": 2})
    rules = {"categories": spark.createDataFrame([("data engineer", "Technology", 1), ("sales", None, 1)], "keyword string, job_category string, priority int"), "levels": spark.createDataFrame([("senior", "Mid-Senior", 1)], "keyword string, experience_level string, priority int"), "skills": spark.createDataFrame([("data engineer", "Data engineering")], "keyword string, skill_name string")}
    assert pipeline.run(*args, sources=["ashby", "jooble"], dry_run=True) == [(s, "planned", 0.0) for s in pipeline.STEPS]
    assert [x[:2] for x in pipeline.run(*args, sources=["ashby", "jooble"], **rules)] == [(s, "ok") for s in pipeline.STEPS]
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    listings = {(r["source_name"], r["source_job_id"]): r for r in read("listings").collect()}
    assert set(listings) == {("ashby", "1"), ("ashby", "2"), ("jooble", "9"), ("jooble", "8")}
    first = listings["ashby", "1"]
    assert (first["copies_landed"], str(first["first_seen_date"]), str(first["last_seen_date"]), first["is_active"]) == (3, "2026-09-01", "2026-09-02", False)
    assert listings["jooble", "9"]["title_norm"] == "data engineer" and listings["jooble", "9"]["is_active"] is None and str(listings["jooble", "9"]["first_seen_date"]) == "2026-09-03"
    assert (listings["jooble", "8"]["city_std"], listings["jooble", "8"]["region_std"], listings["jooble", "8"]["cities_named"]) == (None, None, 2)
    jobs = {r["title"]: r for r in read("openings").collect()}
    assert (jobs["Data Engineer"]["listing_count"], jobs["Data Engineer"]["match_tier"], jobs["Data Engineer"]["lifecycle_status"]) == (2, "exact", "open")
    assert (jobs["Sales Lead"]["lifecycle_status"], str(jobs["Sales Lead"]["disappeared_date"]), jobs["Sales Lead"]["days_listed"]) == ("disappeared", "2026-09-02", 1)
    assert jobs["Senior Data Engineer"]["lifecycle_status"] == "unknown"
    assert read("fct_jobs").count() == 3 and quality.one_unknown_member(read("dim_company"), "company_sk").isEmpty()
    assert quality.relationships(read("fct_jobs"), "company_sk", read("dim_company"), "company_sk").isEmpty()
    engineer, sales, senior = jobs["Data Engineer"], jobs["Sales Lead"], jobs["Senior Data Engineer"]
    assert (engineer["job_category"], sales["job_category"], engineer["experience_level_basis"], senior["experience_level"], senior["experience_level_basis"]) == ("Technology", "Unknown", "unknown", "Mid-Senior", "title")
    assert (engineer["is_baseline"], engineer["opening_date"], str(sales["open_until_date"]), sales["is_censored"], sales["days_listed_basis"]) == (True, None, "2026-09-01", False, "first_seen")
    assert engineer["salary_is_parsed"] and (engineer["salary_min_sar_month"], engineer["salary_max_sar_month"]) == (9000.0, 10000.0) and senior["salary_text"] is None
    assert {(r["board"], str(r["pull_date"]), r["is_successful"], r["is_baseline"]) for r in read("pulls").where("source_name = 'jooble'").collect()} == {("jooble", "2026-09-03", True, True), ("jooble", "2026-09-02", False, False)}
    assert {r["matched_in"] for r in read("bridge_job_skill").collect()} == {"title"} and read("dim_skill").count() == 1 and read("dim_date").count() > 2
    for key, dim in (("role_sk", "dim_role"), ("source_sk", "dim_source"), ("location_sk", "dim_location"), ("job_attributes_sk", "dim_job_attributes"), ("posting_sk", "dim_job_posting"), ("first_seen_date_sk", "dim_date")):
        parent = "date_sk" if dim == "dim_date" else key
        assert quality.relationships(read("fct_jobs"), key, read(dim), parent).isEmpty(), dim
    matched = read("jobs_matched")
    assert quality.one_per_group(matched, ["job_sk"], "is_representative").isEmpty() and matched.count() == len(listings)


def test_landing(spark, raw):
    ashby = scan(spark, str(raw / "ashby"))
    ok = {(r["board"], str(r["ingest_date"])): (r["is_successful"], r["postings"]) for r in landed_files(ashby, "ashby").collect()}
    assert ok == {("acme", "2026-09-01"): (True, 2), ("acme", "2026-09-02"): (True, 2), ("acme", "2026-09-03"): (False, 0), ("quiet", "2026-09-01"): (True, 0)}
    assert Counter(r["is_successful"] for r in landed_files(scan(spark, str(raw / "jooble")), "jooble").collect()) == {True: 1, False: 2}
    with pytest.raises((PySparkException, Py4JJavaError)):
        scan(spark, str(raw / "jooble"), strict=True).select(F.col("raw_data").cast("string")).collect()
    with pytest.raises(ValueError, match="unknown source"):
        check_sources(["nowhere"])
    pages = spark.createDataFrame([(1, 200), (2, 429), (3, 200)], "page int, http_status int")
    assert [r["page"] for r in missing_pages(pages.select("page"), pages, ["page"]).collect()] == [2]
    log = spark.createDataFrame([("j", i, n) for i, n in enumerate([9, 5, 1, 1, 1, 1, 1, 0])], "source_name string, seq int, new_rows int")
    assert should_stop(log, "seq", "new_rows").first()["stop_at"] == 5


def test_incremental_load_boards_and_files(spark, raw, tmp_path):
    target = [str(raw), str(tmp_path / "t"), str(tmp_path / "c")]
    assert load_new_files(spark, *target) == 7 and load_new_files(spark, *target) == 0
    land(raw, "ashby", "2026-09-09", "late.json", {"jobs": []})
    assert load_new_files(spark, *target) == 1 and spark.read.parquet(target[1]).count() == 8
    boards.register(spark)
    got = spark.read.format("boards").option("folder", str(raw / "ashby" / "ingest_date=2026-09-01")).load()
    assert {(r["board"], r["position"]) for r in got.collect()} == {("acme", 0), ("acme", 1)}
    assert files.copy_once(raw, tmp_path / "copy") and files.copy_once(raw, tmp_path / "copy") == []
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    path = files.export_parquet(df, str(tmp_path / "x"), "t", "2026-09-01", "r1", files=1)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(AnalysisException):
        files.export_parquet(df, str(tmp_path / "x"), "t", "2026-09-01", "r1")
    files.export_csv(df, str(tmp_path / "csv"))
    assert files.seed(spark, str(tmp_path / "csv"), "a int, b string").collect() == df.collect()
    waits, calls = [], iter([OSError("x"), OSError("y"), "ok"])

    def fetch():
        r = next(calls)
        if isinstance(r, OSError):
            raise r
        return r

    assert boards.retrying(fetch, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError, match="fuzzy_match_function"):
        Config(fuzzy_match_function="other")
