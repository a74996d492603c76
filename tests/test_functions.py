from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import dates, keys, text, writing
from sightline.functions.similarity import jaccard, jaro_winkler, jaro_winkler_score


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*map(F.col, names)).alias("x")).first()[0]


def test_text_keys(spark):
    assert one(spark, text.normalize_text, "  A-b_C.d ") == "a b c d"
    assert one(spark, text.normalize_text, " .,- ") is None
    assert one(spark, text.normalize_text, None) is None
    assert one(spark, text.normalize_title, "Pricing Lead – Middle East") == one(spark, text.normalize_title, "Pricing Lead - Middle East")
    assert one(spark, text.normalize_title, "IT Support & Networks") == "it support and networks"
    assert one(spark, text.normalize_title, "(Accountant)") == "accountant"
    assert one(spark, text.normalize_title, "Urgent hiring Sr. Engineer [KSA]") == "senior engineer"
    assert one(spark, text.normalize_company, "The Foo Co. Ltd Careers Page") == "foo"
    assert one(spark, lambda c: text.remove_words(c, ["urgent", "hiring", "required", "needed"]), "urgent hiring required needed engineer") == "needed engineer"
    assert one(spark, text.strip_html, "&lt;p&gt;A&amp;nbsp;B") == "A B"
    assert one(spark, text.normalize_employment_type, "FULLTIME, PARTTIME") == "Full-time and Part-time"
    assert one(spark, text.normalize_employment_type, "Gig") == "Gig"
    assert one(spark, text.level_signature, "senior project manager 2") == "senior manager ii "
    assert one(spark, lambda c: text.publisher_key(c, F.lit("jooble")), "www.Job-Rapido.com") == "jobrapido"
    assert one(spark, lambda c: text.publisher_key(c, F.lit("jooble")), "") == "jooble:unknown"


def test_writing(spark):
    assert one(spark, writing.content_only, "Full-Time&amp;nbsp;٣ ") == "fulltime3"
    assert one(spark, writing.content_only, None) == ""
    assert one(spark, writing.plain_spaces, " a\xa0 b\n") == "a b"


def test_dates_and_keys(spark):
    row = spark.sql("select timestamp'2026-09-28 22:00:00' as t, date'2026-09-30' as d").select(dates.business_date(F.col("t")).cast("string"), dates.week_start(F.col("d")).cast("string"), dates.date_key(F.col("d")), dates.date_key(F.lit(None).cast("date"))).first()
    assert tuple(row) == ("2026-09-29", "2026-09-27", 20260930, -1)
    assert one(spark, dates.board_from_path, "ashby/ingest_date=2026-09-01/acme_jobs.json") == "acme"
    assert one(spark, dates.ingest_date_from_path, "ashby/x.json") is None
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert keys.fingerprint(a).first() == keys.fingerprint(a.orderBy(F.desc("a"))).first()


def test_similarity(spark):
    assert one(spark, jaccard, "data analyst", "data analyst intern") == 66.7
    assert abs(jaro_winkler_score("data analyst", "data analyst intern") - 0.9263) < 1e-3
    assert jaro_winkler_score(None, "a") is None and jaro_winkler_score("", "a") == 0.0 and jaro_winkler_score("", "") == 1.0
    assert one(spark, jaro_winkler, "martha", "marhta") == jaro_winkler_score("martha", "marhta")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_is_a_symmetric_similarity(a, b):
    s = jaro_winkler_score(a, b)
    assert 0 <= s <= 1 and (s == 1.0) == (a == b) or a != b
    assert abs(s - jaro_winkler_score(b, a)) < 1e-9


def test_content_keeps_currency_and_decimal_points(spark):
    for a, b, same in [("$4000", "€4000", False), ("12.5k", "125k", False), ("12.5k", "12,5 K", True), ("SAR 5,000.", "sar 5000", True), ("1.234.567", "1234567", True)]:
        assert (one(spark, writing.content_only, a) == one(spark, writing.content_only, b)) == same
