"""Dictionary matching: whole-word containment as a hash join, and what is decided on its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import has_word
from sightline.session import bounded_broadcast


def contains_join(df: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Baseline for tests: every row with every dictionary word its text holds (nested loop)."""
    return df.join(bounded_broadcast(words), has_word(F.col(text), F.col(word)))


def longest_entry(words: DataFrame, word: str) -> int:
    """Words of a dictionary's longest entry: one number, whatever its size."""
    return words.agg(F.max(F.size(F.split(F.trim(word), r"\s+")))).first()[0] or 1


def ngram_join(df: DataFrame, key: list[str], text: str, words: DataFrame, word: str, longest: int | None = None) -> DataFrame:
    """The same rows by an equi join on the text's n-grams of up to ``longest`` words.

    By default as many as the longest entry has. The rows' n-grams never travel: the
    dictionary is broadcast after a check of its size, and shuffled against where it is too
    large. Only hits are made distinct. Null texts match nothing.
    """
    most = longest_entry(words, word) if longest is None else longest
    each = df.where(F.col(text).isNotNull()).withColumn("_t", F.split(F.col(text), " ")).select("*", F.posexplode("_t").alias("_i", "_w"))
    grams = F.array_compact(F.array("_w", *[F.when(F.col("_i") + n <= F.size("_t"), F.array_join(F.slice("_t", F.col("_i") + 1, n), " ")) for n in range(2, most + 1)]))
    keyed = each.withColumn("_g", F.explode(grams)).drop("_t", "_i", "_w")
    return keyed.join(bounded_broadcast(words), F.col("_g") == F.col(word)).drop("_g").dropDuplicates([*key, text, word])


def tag_by_priority(hits: DataFrame, key: list[str], priority: str, word: str, label: str) -> DataFrame:
    """One label per key: lowest priority, longest word, then the word; a null label blocks the rest."""
    best = hits.groupBy(*key).agg(F.min(F.struct(F.col(priority).alias("p"), (-F.length(word)).alias("l"), F.col(word).alias("w"), F.col(label).alias("v"))).alias("_b"))
    return best.select(*key, F.col("_b.v").alias(label))


def tag_all(hits: DataFrame, key: list[str], label: str, in_title: Column) -> DataFrame:
    """All labels per key, each with where it was found: the title if any hit is there."""
    return hits.groupBy(*key, label).agg(F.when(F.bool_or(in_title), "title").otherwise("description").alias("matched_in"))


def resolve_place(rows: DataFrame, key: str, field: str, text: str, places: DataFrame, longest: int | None = None) -> DataFrame:
    """City, region and level of each row from a place dictionary (alias, city_std, region_std).

    The city field goes before free text; a hit inside a longer hit of the same row and flag is
    dropped; several cities give no city, and a region only if they share it. Rows without a
    hit are on country level. Ties by position, longer alias, alias. Each distinct pair of
    field and text is resolved once; its hits, no more than its words begin aliases, are
    decided within one aggregate.
    """
    pairs = rows.select(F.col(field).alias("_f"), F.col(text).alias("_x")).distinct().where("_f is not null or _x is not null")
    laid = pairs.select("_f", "_x", F.inline(F.array(F.struct(F.lit(True).alias("n"), F.col("_f").alias("v")), F.struct(F.lit(False).alias("n"), F.col("_x").alias("v")))))
    hits = ngram_join(laid, ["_f", "_x", "n"], "v", places, "alias", longest)
    hits = hits.withColumn("at", F.expr("position(concat(' ', alias, ' '), concat(' ', v, ' '))")).withColumn("to", F.col("at") + F.length("alias"))
    kept = hits.groupBy("_f", "_x").agg(F.collect_list(F.struct("n", "at", "to", "alias", "city_std", "region_std")).alias("h"))
    kept = kept.withColumn("h", F.filter("h", lambda a: a["n"] == F.exists("h", lambda b: b["n"])))
    inside = lambda a: F.exists("h", lambda b: (b["at"] <= a["at"]) & (b["to"] >= a["to"]) & (F.length(b["alias"]) > F.length(a["alias"])))
    kept = kept.withColumn("h", F.filter("h", lambda a: ~inside(a)))
    each = lambda c: F.array_distinct(F.array_compact(F.transform("h", lambda a: a[c])))
    first = F.array_min(F.transform("h", lambda a: F.struct(a["city_std"].isNull().alias("n"), a["at"].alias("a"), (-F.length(a["alias"])).alias("l"), a["alias"].alias("w"), a["city_std"].alias("city"), a["region_std"].alias("region"))))
    kept = kept.select("_f", "_x", F.size(each("city_std")).alias("cities"), each("region_std").alias("regions"), first.alias("best"))
    city = F.when(F.col("cities") <= 1, F.col("best.city"))
    region = F.when(F.col("cities") <= 1, F.col("best.region")).when(F.size("regions") == 1, F.get("regions", F.lit(0)))
    found = kept.select("_f", "_x", city.alias("city"), region.alias("region"), F.col("cities").cast("long").alias("cities_named"))
    level = F.when(F.col("city").isNotNull(), "city").when(F.col("region").isNotNull(), "region").otherwise("country")
    out = rows.select(key, F.col(field).alias("_rf"), F.col(text).alias("_rx")).join(found, F.col("_rf").eqNullSafe(F.col("_f")) & F.col("_rx").eqNullSafe(F.col("_x")), "left")
    return out.select(key, "city", "region", F.coalesce("cities_named", F.lit(0)).alias("cities_named"), level.alias("location_level"))
