"""Queries of this subpackage over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.encoding import TOKENIZERS, encode_corpus
from sightline.llm.linkage import link
from sightline.llm.names import resolve_names
from sightline.llm.packing import pack
from sightline.llm.places import map_countries, map_places
from sightline.llm.residue import find_residue
from sightline.llm.survivors import survivors
from sightline.session import cut_table, small_list, table


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unmatched listings on different sources that are one opening, with confidence."""
    t = lambda n: table(spark, sf_dir, n)
    open_ones = t("int_job_listings").join(t("int_jobs_matched").select("source_record_sk").distinct(), "source_record_sk", "left_anti")
    return link(open_ones, t("seed_city_mapping"), t("seed_company_aliases"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of :func:`p1_links` without their confidence."""
    return p1_links(spark, sf_dir).select("listing_a", "listing_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving listing of each matched job, field by field."""
    t = lambda n: table(spark, sf_dir, n)
    return survivors(t("int_job_listings"), t("int_jobs_matched"), t("seed_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed company that each listing's variant spelling means."""
    t = lambda n: table(spark, sf_dir, n)
    return resolve_names(t("int_job_listings"), "source_record_sk", "company_name", t("seed_company_aliases"), "description_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free places of nash and free countries of stg_ashby_jobs on their reference lists."""
    t = lambda n: table(spark, sf_dir, n)
    nash = t("nash").select(F.lit("nash").alias("tbl"), F.col("id").alias("record_id"), F.col("location").alias("v"))
    ashby = t("stg_ashby_jobs").select(F.lit("stg_ashby_jobs").alias("tbl"), F.col("source_record_sk").alias("record_id"), F.col("country_raw").alias("v"))
    places = map_places(nash, "v", t("seed_city_mapping"))
    lands = map_countries(ashby, "v", t("seed_country_names"))
    return nash.join(places, "v").unionByName(ashby.join(lands, "v")).select("tbl", "record_id", "canonical").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document; empty lists for null and empty texts."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZERS)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each kind."""
    sizes = cut_table(p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n")), "sizes")
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in sorted(small_list(table(spark, sf_dir, "seed_containers").select("container_kind", "capacity_tokens"), 100, "the list of containers"))]
    return pack(sizes, "doc_id", "n", kinds)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unfilled placeholders, filler, error messages or script notices."""
    return find_residue(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found}
ORACLE: dict[str, str] = {}
