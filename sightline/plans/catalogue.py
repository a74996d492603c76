"""The engine's operators as queries over the test tables, with the SQL that checks them.

Names follow the operators of the blueprint. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import dates, keys, similarity, text
from sightline.operators import dictionary, lifecycle, matching, quality, semistructured, survivorship, windows
from sightline.plans import measures, star
from sightline.session import bounded_broadcast, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if plain SQL expresses it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- windows and snapshots -------------------------------------------------------------------


@query("""select event_type, user_id, event_id, ts, value, min(ts) over w as first_seen, max(ts) over w as last_seen, count(*) over w as copies_landed
from events window w as (partition by event_type, user_id) qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "user_id", "event_id", "ts", "value")
    return windows.latest_snapshot(rows, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")], "ts")


@query("""with s as (select source_name, board, source_job_id, min(ingest_date) first_seen, max(ingest_date) last_seen from board_snapshots group by all), b as (select source_name, board, max(ingest_date) board_latest from board_snapshots group by all)
select s.*, board_latest, last_seen = board_latest as is_active from s join b using (source_name, board)""")
def board_activity(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.board_activity(table(spark, d, "board_snapshots"), ["source_job_id"], ["source_name", "board"], "ingest_date")


@query("""with c as (select source_name, board, pull_date, count(*) filter (is_successful) > 0 as is_successful, count(*) as tries from int_board_pulls group by all)
select *, coalesce(is_successful and pull_date = min(case when is_successful then pull_date end) over (partition by source_name, board), false) as is_baseline from c""")
def pull_calendar_baseline(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.pull_calendar(table(spark, d, "int_board_pulls"), ["source_name", "board"], "pull_date", "is_successful")


@query("""with c as (select source_name, board, pull_date from int_board_pulls group by all having count(*) filter (is_successful) > 0),
s as (select source_name, board, source_job_id, max(ingest_date) as last_seen from board_snapshots group by all)
select s.*, count(c.pull_date) as missed_pulls, count(c.pull_date) >= 1 as is_disappeared, min(c.pull_date) as disappeared_date from s left join c on s.source_name = c.source_name and s.board = c.board and c.pull_date > s.last_seen group by all""")
def missed_pulls_range_join(spark: SparkSession, d: str) -> DataFrame:
    cal = lifecycle.pull_calendar(table(spark, d, "int_board_pulls"), ["source_name", "board"], "pull_date", "is_successful")
    seen = table(spark, d, "board_snapshots").groupBy("source_name", "board", "source_job_id").agg(F.max("ingest_date").alias("last_seen"))
    return lifecycle.missed_pulls(seen, cal, ["source_name", "board"], ["source_job_id"], "pull_date", "last_seen")


@query("""with p as (select distinct source_name, board, pull_date, (pull_date - (dayofweek(pull_date) * interval 1 day))::date as week from int_board_pulls where is_successful),
f as (select source_name, board, min(pull_date) fp from p group by all), w as (select week, count(distinct (source_name, board)) boards_pulled from p group by week)
select w.week, boards_pulled, (select count(*) from f where fp <= w.week + 6) as boards_expected, boards_pulled = (select count(*) from f where fp <= w.week + 6) as is_full_pull from w""")
def source_week_coverage(spark: SparkSession, d: str) -> DataFrame:
    pulls = table(spark, d, "int_board_pulls").where("is_successful").select("source_name", "board", "pull_date", dates.week_start(F.col("pull_date")).alias("week")).distinct()
    return lifecycle.week_coverage(pulls, ["source_name", "board"], "week", "pull_date").select("week", "boards_pulled", "boards_expected", "is_full_pull")


@query("""with n as (select source_name, board, ingest_date, count(*) as postings from board_snapshots group by all), l as (select *, lag(postings) over (partition by source_name, board order by ingest_date) as previous, row_number() over (partition by source_name, board order by ingest_date desc) r from n)
select source_name, board, ingest_date, postings, previous from l where r = 1 and previous >= 2 and postings < 0.9 * previous""")
def collapsed_pull_check(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "board_snapshots").groupBy("source_name", "board", "ingest_date").agg(F.count(F.lit(1)).alias("postings"))
    return lifecycle.collapsed_pulls(counts, ["source_name", "board"], "ingest_date", "postings", ratio=0.9, least=2)


@query("""with a as (select max(pull_date) as as_of from int_board_pulls where is_successful), c as (select source_name, board, pull_date from int_board_pulls group by all having count(*) filter (is_successful) > 0),
s as (select source_name, board, source_job_id, max(ingest_date) as last_seen from board_snapshots group by all), m as (select s.*, min(c.pull_date) as disappeared_date from s left join c on s.source_name = c.source_name and s.board = c.board and c.pull_date > s.last_seen group by all)
select source_name, board, source_job_id, case when disappeared_date is null then 'open' else 'disappeared' end as lifecycle_status, case when disappeared_date is null then least(as_of, last_seen + 7) else disappeared_date - 1 end as open_until from m, a""")
def lifecycle_status_open_until(spark: SparkSession, d: str) -> DataFrame:
    gone = missed_pulls_range_join(spark, d)
    as_of = table(spark, d, "int_board_pulls").where("is_successful").agg(F.max("pull_date")).first()[0]
    until = lifecycle.open_until(F.col("last_seen"), F.col("disappeared_date"), F.lit(as_of).cast("date"))
    return gone.select("source_name", "board", "source_job_id", F.when(F.col("is_disappeared"), "disappeared").otherwise("open").alias("lifecycle_status"), until.alias("open_until"))


@query("""with a as (select max(ts)::date as as_of from events), n as (select event_type, max(ts) as newest from events group by 1)
select event_type, newest, (as_of - newest::date)::int as age_days, case when as_of - newest::date > 15 then 'error' when as_of - newest::date > 8 then 'warn' else 'pass' end as status from n, a""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    as_of = rows.agg(F.max(F.to_date("ts"))).first()[0]
    return quality.freshness(rows, "ts", F.lit(as_of).cast("date"), by=["event_type"])


@query("select event_type, user_id, event_id, (select count(distinct value) from events x where x.event_type = e.event_type and x.user_id = e.user_id) as values_seen from events e")
def count_distinct_over(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    return windows.count_distinct_over(rows, "value", ["event_type", "user_id"], "values_seen").drop("value")


@query("select lang, doc_id from documents where text is not null qualify row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) <= 5")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return windows.stratified_sample(table(spark, d, "documents").where("text is not null").select("lang", "doc_id"), ["lang"], 5, "doc_id")


@query("""select c_mktsegment, o_orderpriority, n from (select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by all) qualify row_number() over (partition by c_mktsegment order by n desc, o_orderpriority) = 1""")
def mode_with_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return windows.mode_with_tiebreak(rows, ["c_mktsegment"], "o_orderpriority").select("c_mktsegment", "o_orderpriority", "n")


@query("select p_brand, count(*) as parts from part group by 1 qualify rank() over (order by count(*) desc) <= 10")
def topn_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_n_with_ties(table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts")), 10, "parts")


@query("select user_id, event_id, lag(value) over (partition by user_id order by ts, event_id) as previous, avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as mean_of_5 from events")
def lag_and_moving_mean(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lag("value").over(w).alias("previous"), F.avg("value").over(w.rowsBetween(-4, 0)).alias("mean_of_5"))


# --- semi-structured -------------------------------------------------------------------------


@query("select event_id, (props::json ->> '$.k') as k_text, try_cast(props::json ->> '$.k' as bigint) as k_number, (props::json ->> '$.missing') as absent from events")
def variant_extract(spark: SparkSession, d: str) -> DataFrame:
    v = semistructured.parse(F.col("props"))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", semistructured.at(F.col("v"), "$.k").alias("k_text"), semistructured.at(F.col("v"), "$.k", "bigint").alias("k_number"), semistructured.at(F.col("v"), "$.missing").alias("absent"))


@query("select p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos, unnest(string_split(p_name, ' ')) as item from part")
def variant_explode_array(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.try_parse_json(F.to_json(F.split("p_name", " "))).alias("v"))
    return semistructured.explode_array(rows, "v").select("p_partkey", F.col("pos").cast("long").alias("pos"), semistructured.at(F.col("item"), "$").alias("item"))


@query("select user_id, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'view' then value end) as view, max(case when event_type = 'purchase' then value end) as purchase from events group by 1")
def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    return semistructured.pivot_names(table(spark, d, "events"), ["user_id"], "event_type", "value", {"click": "click", "view": "view", "purchase": "purchase"})


@query("select n_nationkey, nullif(concat_ws(', ', n_name, r_name), '') as place from nation left join region on n_regionkey = r_regionkey")
def compact_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(bounded_broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("n_nationkey", semistructured.compact_join(", ", F.col("n_name"), F.col("r_name")).alias("place"))


# --- text, dates, keys -----------------------------------------------------------------------

_NORM = "nullif(trim(regexp_replace(regexp_replace(lower({0}), '[[:punct:]]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '')"


def _remove(expr: str, noise: list[str]) -> str:
    pattern = " (" + "|".join(noise) + ") "
    return f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(' ' || {expr} || ' ', '{pattern}', ' ', 'g'), '{pattern}', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')), '')"


def _title(expr: str) -> str:
    prepared = f"regexp_replace(replace(lower({expr}), '&', ' and '), '[{text.TITLE_MARKS}]', ' ', 'g')"
    bare = f"regexp_replace({prepared}, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')"
    out = f"' ' || coalesce({_NORM.format(bare)}, {_NORM.format(prepared)}) || ' '"
    for short, long in text.TITLE_SHORT.items():
        out = f"regexp_replace({out}, ' {short} ', ' {long} ', 'g')"
    return _remove(out, text.TITLE_NOISE)


@query(f"select source_record_sk, {_NORM.format('job_title')} as title_text from int_job_listings group by all")
def normalize_text_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "int_job_listings").select("source_record_sk", text.normalize_text(F.col("job_title")).alias("title_text")).distinct()


@query(f"select source_record_sk, {_title('job_title')} as title_key from int_job_listings group by all")
def normalize_title_listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "int_job_listings").select("source_record_sk", text.normalize_title(F.col("job_title")).alias("title_key")).distinct()


@query(f"select source_record_sk, {_remove(_NORM.format('company_name'), text.COMPANY_NOISE)} as company_key from int_job_listings group by all")
def normalize_company_listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "int_job_listings").select("source_record_sk", text.normalize_company(F.col("company_name")).alias("company_key")).distinct()


@query("select p_partkey, " + _remove("p_name || ' hiring urgent now'", ["hiring", "urgent", "now"]) + " as name_key from part")
def remove_words_two_pass(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.remove_words(F.concat(F.col("p_name"), F.lit(" hiring urgent now")), ["hiring", "urgent", "now"]).alias("name_key"))


@query(r"""select doc_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), '') as bare from documents""")
def strip_html_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.strip_html(F.col("text")).alias("bare"))


@query("""with v as (select source_record_sk, employment_type e, lower(replace(replace(trim(employment_type), '-', ''), ' ', '')) k from int_job_listings group by all)
select source_record_sk, case when lower(e) like '%full%time%' and lower(e) like '%part%time%' then 'Full-time and Part-time' when lower(e) like '% and %' or e like '%,%' then 'Other' when k = 'fulltime' then 'Full-time' when k = 'parttime' then 'Part-time' when k in ('contract', 'contractor') then 'Contract' when k in ('intern', 'internship') then 'Internship' when k = 'temporary' then 'Temporary' when k = 'volunteer' then 'Volunteer' when k = 'other' then 'Other' else nullif(trim(e), '') end as employment from v""")
def employment_type_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "int_job_listings").select("source_record_sk", text.normalize_employment_type(F.col("employment_type")).alias("employment")).distinct()


_LEVELS = " || ".join(f"case when contains(' ' || t || ' ', ' {w} ') then '{text.LEVEL_LABELS.get(w, w)} ' else '' end" for w in text.LEVEL_WORDS)


@query(f"select source_record_sk, {_LEVELS} as signature from (select source_record_sk, title_norm as t from int_job_listings group by all)")
def level_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "int_job_listings").select("source_record_sk", text.level_signature(F.col("title_norm")).alias("signature")).distinct()


@query(r"select source_record_sk, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(split_part(split_part(job_url, '//', 2), '/', 1))), '^www\.|\.(com|net|org|io|co|sa)$', '', 'g'), '[[:space:][:punct:]]', '', 'g'), ''), source_name || ':unknown') as publisher_key from int_job_listings group by all")
def publisher_from_url(spark: SparkSession, d: str) -> DataFrame:
    host = F.split_part(F.split_part("job_url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "int_job_listings").select("source_record_sk", text.publisher_key(host, F.col("source_name")).alias("publisher_key")).distinct()


@query("select event_id, ((ts at time zone 'UTC') at time zone 'Asia/Riyadh')::date as business_date, ((ts::date) - (dayofweek(ts) * interval 1 day))::date as week_start from (select event_id, ts::timestamp as ts from events)")
def business_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.business_date(F.col("ts").cast("timestamp")).alias("business_date"), dates.week_start(F.to_date("ts")).alias("week_start"))


@query("select file_name, regexp_replace(split_part(file_name, '/', -1), '(_jobs)?\\.json$', '') as board_of_file, try_cast(nullif(regexp_extract(file_name, 'ingest_date=(\\d{4}-\\d{2}-\\d{2})', 1), '') as date) as landed_on from board_snapshots group by all")
def board_from_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "board_snapshots").select("file_name").distinct()
    return rows.select("file_name", dates.board_from_path(F.col("file_name")).alias("board_of_file"), dates.ingest_date_from_path(F.col("file_name")).alias("landed_on"))


@query("select o_orderkey, md5(concat_ws('-', coalesce(o_orderkey::varchar, '_dbt_utils_surrogate_key_null_'), coalesce(o_orderstatus, '_dbt_utils_surrogate_key_null_'))) as order_sk from orders")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", keys.surrogate_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("order_sk"))


@query()
def fingerprint_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return keys.fingerprint(table(spark, d, "lineitem"))


# --- dictionaries ----------------------------------------------------------------------------

#: A small dictionary with a blocker row (null label), as constants in both engines.
_WORDS = [("piping", "Engineering", 1), ("welding", "Engineering", 1), ("fire systems", "Safety", 2), ("data", "Technology", 3), ("database", "Technology", 2), ("senior data", None, 1), ("network", "Technology", 3), ("sales", "Commerce", 3), ("marketing", "Commerce", 3), ("tax", "Finance", 2), ("credit", "Finance", 3)]
_WORDS_SQL = "(values " + ", ".join(f"('{w}', {'null' if c is None else repr(c)}, {p})" for w, c, p in _WORDS) + ") as k(word, category, priority)"


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WORDS, "word string, category string, priority int")


_CATEGORY = f"""with l as (select distinct source_record_sk, title_norm from int_job_listings)
select source_record_sk, category from (select source_record_sk, category, row_number() over (partition by source_record_sk order by priority, length(word) desc, word) r from l join {_WORDS_SQL} on contains(' ' || title_norm || ' ', ' ' || word || ' ')) where r = 1"""


@query(_CATEGORY)
def keyword_category(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "int_job_listings").select("source_record_sk", "title_norm").distinct()
    return dictionary.tag_by_priority(dictionary.contains_join(rows, "title_norm", _words(spark), "word"), ["source_record_sk"], "priority", "word", "category")


@query(_CATEGORY)
def keyword_category_ngram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "int_job_listings").select("source_record_sk", "title_norm").distinct()
    return dictionary.tag_by_priority(dictionary.ngram_join(rows, ["source_record_sk"], "title_norm", _words(spark), "word"), ["source_record_sk"], "priority", "word", "category")


_SKILLS = f"""with l as (select source_record_sk, any_value(title_norm) t, any_value({_NORM.format('description_text')}) x from int_job_listings group by 1),
h as (select source_record_sk, category, bool_or(coalesce(contains(' ' || t || ' ', ' ' || word || ' '), false)) in_title from l join {_WORDS_SQL} on contains(' ' || t || ' ', ' ' || word || ' ') or contains(' ' || x || ' ', ' ' || word || ' ') where category is not null group by all)"""


def _skill_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "int_job_listings").groupBy("source_record_sk").agg(F.first("title_norm", True).alias("t"), F.first("description_text", True).alias("x"))
    known = _words(spark).where("category is not null")
    both = [rows.select("source_record_sk", c.alias("v"), F.lit(k).alias("in_title")) for k, c in ((True, F.col("t")), (False, text.normalize_text(F.col("x"))))]
    return dictionary.ngram_join(both[0].unionByName(both[1]), ["source_record_sk"], "v", known, "word")


@query(_SKILLS + " select source_record_sk, category, case when in_title then 'title' else 'description' end as matched_in from h")
def skill_tags(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.tag_all(_skill_hits(spark, d), ["source_record_sk"], "category", F.col("in_title"))


@query(_SKILLS + " select category, count(distinct source_record_sk) as listings, round(100.0 * count(distinct source_record_sk) / (select count(distinct source_record_sk) from int_job_listings), 1) as pct from h group by 1")
def skill_share(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "int_job_listings").agg(F.countDistinct("source_record_sk")).first()[0]
    return skill_tags(spark, d).groupBy("category").agg(F.countDistinct("source_record_sk").alias("listings")).withColumn("pct", F.round(100.0 * F.col("listings") / F.lit(base), 1))


_PLACE = f"""with l as (select source_record_sk, any_value({_NORM.format('city_std')}) c, any_value({_NORM.format('location_raw')}) x from int_job_listings group by 1),
h as (select source_record_sk, alias, city_std, region_std, contains(' ' || c || ' ', ' ' || alias || ' ') is true as in_field, case when contains(' ' || c || ' ', ' ' || alias || ' ') is true then strpos(' ' || c || ' ', ' ' || alias || ' ') else strpos(' ' || x || ' ', ' ' || alias || ' ') end as a from l join seed_city_mapping on contains(' ' || c || ' ', ' ' || alias || ' ') or contains(' ' || x || ' ', ' ' || alias || ' ')),
f as (select * from h qualify in_field = bool_or(in_field) over (partition by source_record_sk)),
k as (select * from f where not exists (select 1 from f g where g.source_record_sk = f.source_record_sk and g.a <= f.a and g.a + length(g.alias) >= f.a + length(f.alias) and length(g.alias) > length(f.alias))),
s as (select source_record_sk, count(distinct city_std) n, count(distinct region_std) r, min(region_std) shared from k group by 1),
b as (select * from k qualify row_number() over (partition by source_record_sk order by city_std is null, a, length(alias) desc, alias) = 1)
select l.source_record_sk, case when n <= 1 then b.city_std end as city, case when n <= 1 then b.region_std when r = 1 then shared end as region, coalesce(n, 0) as cities_named,
case when (case when n <= 1 then b.city_std end) is not null then 'city' when (case when n <= 1 then b.region_std when r = 1 then shared end) is not null then 'region' else 'country' end as location_level from l left join s using (source_record_sk) left join b using (source_record_sk)"""


@query(_PLACE)
def place_containment_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "int_job_listings").groupBy("source_record_sk").agg(F.first("city_std", True).alias("c"), F.first("location_raw", True).alias("x"))
    rows = rows.select("source_record_sk", text.normalize_text(F.col("c")).alias("c"), text.normalize_text(F.col("x")).alias("x"))
    return dictionary.resolve_place(rows, "source_record_sk", "c", "x", table(spark, d, "seed_city_mapping"))


# --- matching --------------------------------------------------------------------------------


@query("""with p as (select p_partkey, p_name, p_brand, p_size from part), t as (select a.p_partkey ka, b.p_partkey kb, list_distinct(string_split(a.p_name, ' ')) x, list_distinct(string_split(b.p_name, ' ')) y from p a join p b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey)
select ka as p_partkey_a, kb as p_partkey_b, round(100.0 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 1) as jaccard from t where round(100.0 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 1) >= 50""")
def fuzzy_jaccard_candidates(spark: SparkSession, d: str) -> DataFrame:
    texts = matching.blocked_texts(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], "p_name")
    return matching.pair_keys(matching.score_pairs(texts, "p_name"), "p_partkey").select("p_partkey_a", "p_partkey_b", "jaccard")


@query("select a.p_partkey as p_partkey_a, b.p_partkey as p_partkey_b, round(100 * jaro_winkler_similarity(a.p_name, b.p_name), 2) as score from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def fuzzy_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    texts = matching.blocked_texts(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], "p_name")
    octets = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")  # noqa: E731  # the SQL compares bytes, and two empty names as unlike
    score = F.when((F.col("p_name_a") == "") & (F.col("p_name_b") == ""), 0.0).otherwise(similarity.jaro_winkler(octets("p_name_a"), octets("p_name_b")))
    scored = texts.withColumn("score", F.round(100 * score, 2))
    return matching.pair_keys(scored, "p_partkey").select("p_partkey_a", "p_partkey_b", "score")


@query("""with t as (select a.p_partkey ka, b.p_partkey kb, list_distinct(string_split(a.p_name, ' ')) x, list_distinct(string_split(b.p_name, ' ')) y from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey),
s as (select ka, kb, round(100.0 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 1) j from t), e as (select ka x, kb y, j from s where j >= 50 union all select kb, ka, j from s where j >= 50), b as (select x, y, j from e qualify row_number() over (partition by x order by j desc, y) = 1)
select b.x as p_partkey_a, b.y as p_partkey_b, b.j as jaccard from b join b c on b.x = c.y and b.y = c.x where b.x < b.y""")
def mutual_best_merge(spark: SparkSession, d: str) -> DataFrame:
    return matching.mutual_best_texts(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], "p_name", 50.0)


@query("""with c as (select distinct source_record_sk, company_name, city_std, title_norm, publisher, source_name, posting_date from int_job_listings where company_name is not null and city_std is not null and title_norm is not null)
select source_record_sk, dense_rank() over (partition by title_norm, company_name, city_std, publisher, source_name order by posting_date nulls last, source_record_sk) as pair_rank from c""")
def exact_groups_rank_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "int_job_listings").where("company_name is not null and city_std is not null and title_norm is not null").select("source_record_sk", "company_name", "city_std", "title_norm", "publisher", "source_name", "posting_date").distinct()
    out = matching.exact_groups(rows, ["title_norm", "company_name", "city_std"], ["publisher", "source_name"], [F.asc_nulls_last("posting_date"), F.asc("source_record_sk")])
    return out.select("source_record_sk", F.col("pair_rank").cast("long").alias("pair_rank"))


@query("""with p as (select a.p_partkey ka, b.p_partkey kb from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey), s as (select distinct l_partkey k, l_suppkey v from lineitem)
select ka as p_partkey_a, kb as p_partkey_b from p where not exists (select 1 from s x join s y on x.v = y.v where x.k = p.ka and y.k = p.kb)""")
def shared_supplier_veto(spark: SparkSession, d: str) -> DataFrame:
    return matching.unshared_pairs(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


# --- survivorship, aggregates ----------------------------------------------------------------


@query("""select o_custkey, arg_min(l_shipdate, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end * 1000000000 + l_orderkey * 10 + l_linenumber) as first_ship, coalesce(min(case when o_orderstatus = 'F' then o_orderdate end), min(o_orderdate)) as first_order, count(*) as lines from (select distinct o_custkey, l_orderkey, l_linenumber, min(l_shipdate) over (partition by l_orderkey, l_linenumber) l_shipdate, min(l_returnflag) over (partition by l_orderkey, l_linenumber) l_returnflag, o_orderdate, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def survivorship_first_known(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_returnflag").alias("l_returnflag"))
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * F.lit(1000000000).cast("long") + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.groupBy("o_custkey").agg(survivorship.first_known(F.col("l_shipdate"), rank).alias("first_ship"), survivorship.prefer(F.col("o_orderdate"), F.col("o_orderstatus") == "F").alias("first_order"), F.count(F.lit(1)).alias("lines"))


@query("""with r as (select distinct job_sk, source_record_sk from int_jobs_matched) select job_sk, source_record_sk, row_number() over (partition by job_sk order by source_record_sk) = 1 as is_representative from r""")
def one_representative(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.representative(table(spark, d, "int_jobs_matched").select("job_sk", "source_record_sk").distinct(), ["job_sk"], [F.asc("source_record_sk")])


@query("select user_id, string_agg(distinct event_type, ', ' order by event_type) as kinds, count(*) filter (value > 50) as large, count(distinct case when value > 50 then event_type end) as large_kinds, bool_or(value > 99) as any_top, median(value) as middle from events group by 1")
def aggregate_toolbox(spark: SparkSession, d: str) -> DataFrame:
    big, rows = F.col("value") > 50, table(spark, d, "events")
    per = rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("kinds"), F.count_if(big).alias("large"), F.countDistinct(F.when(big, F.col("event_type"))).alias("large_kinds"), F.bool_or(F.col("value") > 99).alias("any_top"))
    return per.join(windows.exact_median(rows, ["user_id"], "value"), "user_id", "left")


@query("select coalesce(source_name, 'TOTAL') as source_name, count(*) as copies, count(distinct source_job_id) as postings from board_snapshots group by rollup (source_name)")
def audit_with_total_row(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "board_snapshots").rollup("source_name").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("source_job_id").alias("postings")).withColumn("source_name", F.coalesce("source_name", F.lit("TOTAL")))


@query("""select 'orders' as "check", (select count(*) from orders) as left_rows, (select count(distinct l_orderkey) from lineitem) as right_rows, case when (select count(*) from orders) = (select count(distinct l_orderkey) from lineitem) then 'OK' else 'CHECK' end as status""")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.reconciles(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey").distinct(), "orders")


@query("""select 'priority known' as rule, 'warn' as severity, (select count(*) from int_job_listings where source_priority is null) as failures, case when (select count(*) from int_job_listings where source_priority is null) = 0 then 'pass' else 'warn' end as status
union all select 'board known', 'block', (select count(*) from nash where board is not null and board not in (select board from seed_boards)), case when (select count(*) from nash where board is not null and board not in (select board from seed_boards)) = 0 then 'pass' else 'fail' end
union all select 'one row per day', 'warn', (select count(*) from (select 1 from int_board_pulls group by source_name, board, pull_date having count(*) > 1)), case when (select count(*) from (select 1 from int_board_pulls group by source_name, board, pull_date having count(*) > 1)) = 0 then 'pass' else 'warn' end
union all select 'discount in range', 'block', (select count(*) from lineitem where l_discount < 0 or l_discount > 0.1), case when (select count(*) from lineitem where l_discount < 0 or l_discount > 0.1) = 0 then 'pass' else 'fail' end""")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return quality.run_rules([
        quality.Rule("priority known", lambda: quality.not_null(t("int_job_listings"), "source_priority"), "warn"),
        quality.Rule("board known", lambda: quality.relationships(t("nash"), "board", t("seed_boards"), "board")),
        quality.Rule("one row per day", lambda: quality.unique(t("int_board_pulls"), "source_name", "board", "pull_date"), "warn"),
        quality.Rule("discount in range", lambda: quality.accepted_range(t("lineitem"), "l_discount", 0, 0.1)),
    ])


# --- star schema, questions, measures --------------------------------------------------------


@query("select md5(concat_ws('-', o_orderstatus, o_orderpriority)) as order_kind_sk, o_orderstatus, o_orderpriority from orders group by all")
def junk_dimension(spark: SparkSession, d: str) -> DataFrame:
    return star.junk_dimension(table(spark, d, "orders"), "order_kind_sk", ["o_orderstatus", "o_orderpriority"])


@query("""select strftime(x, '%Y%m%d')::int as date_sk, x::date as full_date, dayname(x) as day_of_week, (x::date - (dayofweek(x) * interval 1 day))::date as week_start_date, month(x)::int as month, quarter(x)::int as quarter, year(x)::int as year, isodow(x) in (5, 6) as is_weekend from range(date '2024-01-01', date '2026-01-01', interval 1 day) t(x) union all select -1, null, null, null, null, null, null, false""")
def dim_date_roles(spark: SparkSession, d: str) -> DataFrame:
    return star.date_dimension(spark, "2024-01-01", "2025-12-31")


@query("""select coalesce(r_name, 'Unknown') as region, round(sum(o_totalprice), 2) as revenue, count(*) as orders from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1""")
def star_region_totals(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    places = t("nation").join(bounded_broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    buyers = t("customer").join(bounded_broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "r_name")
    # Aggregated by customer first: the join carries one row per customer, not per order.
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return spent.join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.coalesce("r_name", F.lit("Unknown")).alias("region")).agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("orders").alias("orders"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_discount) as avg_disc, count(*) as lines from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("lines"))


@query("""select workplace_type, count(*) as listings, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct_of_known, round(100.0 * sum(count(*)) over () / (select count(*) from int_job_listings), 1) as known_share from int_job_listings where workplace_type <> 'Unknown' group by 1""")
def share_of_known(spark: SparkSession, d: str) -> DataFrame:
    # Counted once per value; totals are sums over the few values.
    per = table(spark, d, "int_job_listings").groupBy("workplace_type").agg(F.count(F.lit(1)).alias("listings"))
    w = W.partitionBy(F.lit(1))
    out = per.withColumn("_all", F.sum("listings").over(w)).where("workplace_type <> 'Unknown'").withColumn("_known", F.sum("listings").over(w))
    return out.select("workplace_type", "listings", F.round(100.0 * F.col("listings") / F.col("_known"), 1).alias("pct_of_known"), F.round(100.0 * F.col("_known") / F.col("_all"), 1).alias("known_share"))


@query("""with c as (select region_std, experience_level, count(*) as n from int_job_listings where region_std is not null and experience_level <> 'Unknown' group by all)
select region_std, experience_level, n, round(100.0 * n / sum(n) over (partition by region_std), 1) as pct, sum(n) over (partition by region_std)::bigint as base from c qualify sum(n) over (partition by region_std) >= 20""")
def min_base_suppression(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "int_job_listings").where("region_std is not null and experience_level <> 'Unknown'").groupBy("region_std", "experience_level").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("base", F.sum("n").over(W.partitionBy("region_std"))).where("base >= 20")
    return c.select("region_std", "experience_level", "n", F.round(100.0 * F.col("n") / F.col("base"), 1).alias("pct"), "base")


@query("""select (o_orderdate::date - (dayofweek(o_orderdate) * interval 1 day))::date as week_start, median(o_totalprice) as middle, count(*) as orders from orders group by 1""")
def median_by_week(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(dates.week_start(F.to_date("o_orderdate")).alias("week_start"), "o_totalprice")
    counts = rows.groupBy("week_start").agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(windows.exact_median(rows, ["week_start"], "o_totalprice"), "week_start", "left")


@query("""with c as (select n_regionkey, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by all) select *, round(100.0 * customers / sum(customers) over (partition by n_regionkey), 1) as pct_of_region from c""")
def share_within_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(bounded_broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    per = rows.groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("customers"))
    return per.withColumn("pct_of_region", windows.share_within(F.col("customers"), ["n_regionkey"]))


@query("""with p as (select o_custkey, count(*) v from orders group by 1), r as (select v, rank() over (order by v desc) k from p)
select sum(v) filter (k <= 10)::bigint as top_value, sum(v)::bigint as all_value, round(100.0 * sum(v) filter (k <= 10) / sum(v), 1) as top_share from r""")
def measures_concentration(spark: SparkSession, d: str) -> DataFrame:
    return measures.concentration(table(spark, d, "orders").select("o_custkey", F.lit(1).alias("one")), "o_custkey", "one", 10)


@query("""with e as (select event_type, count(*) as events, count(*) filter (value > 50) as large from events group by 1) select event_type, 'all' as source, events as value from e union all select event_type, 'large', large from e""")
def measures_by_source_unpivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 50).alias("large"))
    return measures.unpivot_sources(e, {"events": "all", "large": "large"}, ["event_type"])


@query("""select match_tier, sum(job_count)::bigint as jobs, count(distinct posting_sk) as postings, sum(listing_count)::bigint as listings, coalesce(sum(case when lifecycle_status = 'open' then job_count end), 0)::bigint as open_jobs, round(100.0 * coalesce(sum(case when lifecycle_status = 'open' then job_count end), 0) / sum(job_count), 1) as open_share from (select distinct on (job_sk) * from fct_jobs order by job_sk, posting_sk, lifecycle_status, match_tier, job_count, listing_count) group by 1""")
def measures_core(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "fct_jobs").groupBy("job_sk").agg(F.min(F.struct("posting_sk", "lifecycle_status", "match_tier", "job_count", "listing_count")).alias("r")).select("r.*")
    is_open = F.col("lifecycle_status") == "open"
    return one.groupBy("match_tier").agg(F.sum("job_count").alias("jobs"), F.countDistinct("posting_sk").alias("postings"), F.sum("listing_count").alias("listings"), measures.total(F.col("job_count"), is_open).alias("open_jobs"), measures.share(measures.total(F.col("job_count"), is_open), measures.total(F.col("job_count"))).alias("open_share"))


@query("""select d.week_start_date, count(*) as first_seen_jobs from (select distinct on (job_sk) * from fct_jobs order by job_sk, first_seen_date_sk) f join (select strftime(x, '%Y%m%d')::int as date_sk, (x::date - (dayofweek(x) * interval 1 day))::date as week_start_date from range(date '2020-01-01', date '2030-01-01', interval 1 day) t(x)) d on f.first_seen_date_sk = d.date_sk group by 1""")
def role_playing_date(spark: SparkSession, d: str) -> DataFrame:
    days = star.date_dimension(spark, "2020-01-01", "2029-12-31").select("date_sk", "week_start_date")
    jobs = table(spark, d, "fct_jobs").groupBy("job_sk").agg(F.min("first_seen_date_sk").alias("date_sk")).groupBy("date_sk").agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(bounded_broadcast(days), "date_sk").groupBy("week_start_date").agg(F.sum("n").alias("first_seen_jobs"))


@query()
def stream_load_available_now(spark: SparkSession, d: str) -> DataFrame:
    """Documents' hosts written as landed files, loaded twice: the second load finds nothing new."""
    import uuid

    from sightline.session import shared_dir
    from sightline.streaming.load import load_new_files

    root = f"{shared_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    pulls = table(spark, d, "int_board_pulls").groupBy("source_name", "pull_date").agg(F.count(F.lit(1)).alias("boards"))
    pulls.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{root}/landed")
    loads = [load_new_files(spark, f"{root}/landed", f"{root}/raw", f"{root}/checkpoint", pattern="part-*") for _ in range(2)]
    return spark.createDataFrame([("first", loads[0]), ("second", loads[1])], "load string, files long")
