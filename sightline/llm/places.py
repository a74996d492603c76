"""Mapping free-entered values to a canonical list by token-level repair.

Each distinct token of the values is joined to the reference vocabulary by edit distance
(across scripts, through a folded form); the corrected tokens are then combined with soft
TF-IDF to rank the complete entries of the list. Values without an entry, and values
that name two different ones, are reported as unmatched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.writing import plain_spaces
from sightline.llm.spelling import Vocabulary, fold, is_arabic, words
from sightline.session import small_list

UNMATCHED = "UNMATCHED"
# Words around a place that are no part of its name.
AROUND = {"area", "greater", "near", "city", "hq", "industrial", "plot", "remote", "hybrid", "onsite", "on", "site", "the", "of", "town", "downtown", "district", "headquarters", "office", "north", "south", "east", "west", "northern", "southern", "eastern", "western", "central", "governorate", "محافظة", "مدينة", "حي", "عن", "بعد", "قرب", "م", "و", "أو", "او", "or", "and", "in", "region", "province", "prov", "منطقة"}
# Articles before a name, as written and as misread.
ARTICLES = {"al", "el", "a1", "ad", "ar", "as", "at", "az", "an", "ash", "ال"}
# Arabic words that stand before names, in their Latin form.
GENERIC = {"جبل": "jabal", "وادي": "wadi", "تل": "tall", "قصر": "qasr", "أم": "umm", "ام": "umm", "عين": "ain", "tal": "tall", "um": "umm", "ein": "ain"}
# Other names of countries by code; adjectives and remarks are none.
COUNTRIES = {
    "SA": "sa sau ksa k.s.a saudi saudia kingdom-of-saudi-arabia saudi-arabia-ksa arabie-saoudite saudi-arabien arabia-saudita saudi-arab السعودية المملكة-العربية-السعودية العربية-السعودية",
    "AE": "ae are uae u.a.e emirates the-emirates united-arab-emirates vereinigte-arabische-emirate émirats-arabes-unis الإمارات الامارات الإمارات-العربية-المتحدة",
    "BH": "bh bhr kingdom-of-bahrain bahreïn البحرين مملكة-البحرين", "KW": "kw kwt state-of-kuwait koweït kuweit الكويت دولة-الكويت", "QA": "qa qat state-of-qatar katar قطر دولة-قطر", "OM": "om omn sultanate-of-oman عمان عُمان سلطنة-عمان",
    "EG": "eg egy arab-republic-of-egypt ägypten égypte egipto مصر جمهورية-مصر-العربية", "JO": "jo jor hashemite-kingdom-of-jordan jordanien jordanie الأردن الاردن المملكة-الأردنية-الهاشمية", "LB": "lb lbn lebanese-republic libanon liban لبنان", "IN": "in ind republic-of-india indien inde bharat الهند",
    "PK": "pk pak islamic-republic-of-pakistan باكستان", "PH": "ph phl republic-of-the-philippines philippinen filipinas pilipinas الفلبين", "GB": "gb gbr uk u.k britain great-britain england royaume-uni vereinigtes-königreich großbritannien reino-unido united-kingdom-of-great-britain بريطانيا المملكة-المتحدة",
    "US": "us usa u.s u.s.a us-of-a united-states-of-america états-unis vereinigte-staaten estados-unidos america أمريكا امريكا الولايات-المتحدة الولايات-المتحدة-الأمريكية", "DE": "de deu ger federal-republic-of-germany deutschland allemagne alemania ألمانيا المانيا", "FR": "fr fra french-republic frankreich francia فرنسا", "ES": "es esp kingdom-of-spain spanien espagne españa إسبانيا اسبانيا",
    "IT": "it ita italian-republic italien italie italia إيطاليا ايطاليا", "NL": "nl nld holland niederlande pays-bas nederland kingdom-of-the-netherlands the-netherlands هولندا", "CN": "cn chn prc people-s-republic-of-china chine 中国 الصين", "JP": "jp jpn japon 日本 اليابان", "TH": "th tha kingdom-of-thailand thaïlande تايلاند تايلند", "TR": "tr tur republic-of-turkey republic-of-türkiye türkiye turkiye türkei turquie تركيا",
    "MA": "ma mar kingdom-of-morocco marokko maroc marruecos المغرب المملكة-المغربية", "ZA": "za zaf rsa republic-of-south-africa südafrika afrique-du-sud جنوب-أفريقيا جنوب-إفريقيا", "CA": "ca can kanada كندا", "AU": "au aus commonwealth-of-australia australien australie أستراليا استراليا", "KR": "kr kor republic-of-korea korea-south south-korea-rok südkorea corée-du-sud 대한민국 한국 كوريا-الجنوبية",
}


class Entries:
    """Complete entries (phrase to canonical value) with weights of their words."""

    def __init__(self, phrases: list[tuple[str, str]], keep: set[str]) -> None:
        written = [(tokens, canonical) for phrase, canonical in phrases if (tokens := self.tokens(phrase, keep))]
        self.rows = sorted({(tuple(map(fold, tokens)), canonical) for tokens, canonical in written})
        count: dict[str, int] = {}
        for tokens, _ in self.rows:
            for t in set(tokens):
                count[t] = count.get(t, 0) + 1
        self.idf = {t: math.log(1 + len(self.rows) / c) for t, c in count.items()}
        at = {row: i for i, row in enumerate(self.rows)}
        runs = {"".join(tokens): at[tuple(map(fold, tokens)), canonical] for tokens, canonical in written if len(tokens) > 1}
        self.glued = {fold(run): i for run, i in runs.items()}
        self.vocabulary = Vocabulary({t for tokens, _ in written for t in tokens} | {run for run in runs if len(run) >= 6})
        self.leading = {t[0] for t, _ in self.rows if len(t) > 1}
        self.of: dict[str, list[int]] = {}
        for i, (tokens, _) in enumerate(self.rows):
            for t in set(tokens):
                self.of.setdefault(t, []).append(i)

    @staticmethod
    def tokens(phrase: str, drop: set[str]) -> list[str]:
        return [GENERIC.get(w, w) for w in words(phrase) if w not in drop and not w.isdigit()]

    def rank(self, tokens: list[str], repaired: dict[str, list[tuple[str, float]]]) -> list[tuple[float, int, frozenset[int]]]:
        """(soft TF-IDF score of the entry's weight covered, entry, positions used), best first."""
        seen: dict[int, dict[str, tuple[float, int]]] = {}
        for at, t in enumerate(tokens):
            for w, sim in repaired.get(t, ()):
                if w in self.glued:
                    i = self.glued[w]
                    for x in self.rows[i][0]:
                        old = seen.setdefault(i, {}).get(x, (0.0, -1))
                        seen[i][x] = max(old, (sim, at))
                for i in self.of.get(w, ()):
                    old = seen.setdefault(i, {}).get(w, (0.0, -1))
                    seen[i][w] = max(old, (sim, at))
        out = []
        for i, hit in seen.items():
            total = sum(self.idf[t] ** 2 for t in set(self.rows[i][0]))
            score = sum(self.idf[t] ** 2 * sim for t, (sim, _) in hit.items()) / total
            out.append((score, i, frozenset(at for _, at in hit.values())))
        return sorted(out, key=lambda r: (-r[0], r[1]))


def repair(df: DataFrame, value: str, entries: Entries, drop: set[str]) -> DataFrame:
    """(value, tokens, repaired): distinct values with their tokens joined to the reference vocabulary.

    The join runs over distinct tokens, so a token that a million values share is repaired
    once. The vocabulary comes from a reference list of fixed size.
    """

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": b["v"], "tokens": [split_value(v, drop) for v in b["v"]]})

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "near": [[{"w": w, "s": s} for w, s in entries.vocabulary.near(t)] for t in b["t"]]})

    values = df.select(F.col(value).alias("v")).where(F.col("v").isNotNull()).distinct().mapInPandas(tokenise, "v string, tokens array<string>")
    exploded = values.select("v", F.explode("tokens").alias("t"))
    near = exploded.select("t").distinct().mapInPandas(nearest, "t string, near array<struct<w:string,s:double>>").where(F.size("near") > 0)
    # One row per value and distinct token; a value's list is bounded by its own words.
    fixed = exploded.distinct().join(near, "t").groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("t", "near"))).alias("repaired"))
    return values.join(fixed, "v", "left")


def split_value(value: str, drop: set[str]) -> list[str]:
    """Tokens of a value; articles, numbers and surrounding words dropped, digits misread as letters undone."""
    out = []
    for w in words(value):
        if w in drop or w in ARTICLES or w.isdigit():
            continue
        w = GENERIC.get(w, w)
        if is_arabic(w) and w.startswith("ال") and len(w) > 4:
            w = w[2:]
        out.append(w)
    return out


def best_entry(tokens: list[str], repaired: dict[str, list[tuple[str, float]]], entries: Entries, floor: float, regions: Entries | None = None) -> str:
    """The one entry that a value's repaired tokens name, else the one region, else UNMATCHED."""
    fixed = dict(repaired)
    # Initial letters stand for the generic words before a name.
    for t in tokens:
        if len(t) == 1 and t not in fixed:
            fixed[t] = [(w, 0.9) for w in sorted(entries.leading) if w[0] == fold(t)]
    found: dict[str, frozenset[int]] = {}
    used: set[int] = set()
    for score, i, at in entries.rank(tokens, fixed):
        name = entries.rows[i][1]
        if score < floor or (name not in found and at & used):
            continue
        found.setdefault(name, at)
        used |= at
    if len(found) == 1:
        return next(iter(found))
    if found or regions is None:
        return UNMATCHED
    named = {regions.rows[i][1] for score, i, _ in regions.rank(tokens, {t: regions.vocabulary.near(t) for t in tokens}) if score >= floor}
    return named.pop() if len(named) == 1 else UNMATCHED


class PlaceReader:
    """Reads single values against a place list; repairs of tokens and values are remembered per worker."""

    def __init__(self, entries: Entries, regions: Entries | None = None, drop: set[str] = AROUND, floor: float = 0.78) -> None:
        self.entries, self.regions, self.drop, self.floor = entries, regions, drop, floor
        self.near: dict[str, list[tuple[str, float]]] = {}
        self.known: dict[str, str] = {}

    def read(self, value: str) -> str:
        if value not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
                self.near.clear()
            tokens = split_value(value, self.drop)
            for t in tokens:
                if t not in self.near:
                    self.near[t] = self.entries.vocabulary.near(t)
            self.known[value] = best_entry(tokens, {t: self.near[t] for t in tokens if self.near[t]}, self.entries, self.floor, self.regions)
        return self.known[value]


def map_values(df: DataFrame, value: str, entries: Entries, drop: set[str], floor: float, regions: Entries | None = None) -> DataFrame:
    """(value, canonical) of each distinct non-blank value; :data:`UNMATCHED` if none or two."""
    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tokens, rep in zip(b["tokens"], b["repaired"]):
                pairs = dict(rep) if rep is not None else {}
                fixed = {t: [(x["w"], x["s"]) for x in near] for t, near in pairs.items()}
                out.append(best_entry(list(tokens), fixed, entries, floor, regions))
            yield pd.DataFrame({"v": b["v"], "canonical": out})

    return repair(df, value, entries, drop).mapInPandas(ranked, "v string, canonical string").withColumnRenamed("v", value)


def place_entries(mapping: DataFrame, most: int = 20_000) -> tuple[Entries, Entries]:
    """Cities and regions of a mapping (alias, city_std, region_std); one of more than ``most`` rows is an error."""
    rows = small_list(mapping.select("alias", "city_std", "region_std").where(F.col("alias").isNotNull()), most, "the list of places")
    strip = lambda a: " ".join(w[2:] if is_arabic(w) and w.startswith("ال") and len(w) > 4 else w for w in words(a) if w not in ARTICLES)
    cities = [(strip(r["alias"]), r["city_std"]) for r in rows if r["city_std"]] + [(strip(r["city_std"]), r["city_std"]) for r in rows if r["city_std"]]
    regions = [(r["alias"], r["region_std"]) for r in rows if not r["city_std"]] + [(r["region_std"], r["region_std"]) for r in rows if r["region_std"]]
    return Entries(cities, set()), Entries(regions, AROUND)


def map_places(df: DataFrame, value: str, mapping: DataFrame) -> DataFrame:
    """(value, canonical) of free places: the city, else the region where only one is named.

    Null and blank values have no row; values without letters are unmatched; a value of any
    length is read whole; repeated values give one row.
    """
    cities, regions = place_entries(mapping)
    blank = df.where(F.length(plain_spaces(F.col(value))) > 0)
    return map_values(blank, value, cities, AROUND, 0.78, regions)


def map_countries(df: DataFrame, value: str, countries: DataFrame, most: int = 1000) -> DataFrame:
    """(value, canonical) of free countries; codes and other names must stand alone."""
    rows = small_list(countries.select("country_code", "country_name"), most, "the list of countries")
    drop = {"the", "of"}
    glue = lambda p: "".join(words(p))
    names = {r["country_name"]: [r["country_name"], r["country_code"], *(x.replace("-", " ") for x in COUNTRIES.get(r["country_code"], "").split())] for r in rows}
    exact = {glue(x): name for name, xs in names.items() for x in xs}
    entries = Entries([(x, name) for name, xs in names.items() for x in xs if len(glue(x)) > 3], drop)
    whole = Vocabulary({glue(x) for xs in names.values() for x in xs if len(glue(x)) > 4})
    by_whole: dict[str, set[str]] = {}
    for name, xs in names.items():
        for x in xs:
            by_whole.setdefault(fold(glue(x)), set()).add(name)

    def one(value: str, tokens: list[str], repaired: dict) -> str:
        if (key := glue(value)) in exact:
            return exact[key]
        ranks = [(s, entries.rows[i][1], at, i) for s, i, at in entries.rank(tokens, repaired) if s >= 0.72]
        covered = [r for r in ranks if len(r[2]) == len(set(entries.rows[r[3]][0])) and len(r[2]) * 2 >= len(tokens)]
        if covered:
            most_words = max(len(r[2]) for r in covered)
            best = {r[1] for r in covered if len(r[2]) == most_words}
            return best.pop() if len(best) == 1 else UNMATCHED
        # Run together: two edits in a run of ten letters are another name.
        close = {n for w, sim in whole.near("".join(tokens)) if sim > 0.85 for n in by_whole[w]}
        return close.pop() if len(close) == 1 else UNMATCHED

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v, tokens, rep in zip(b["v"], b["tokens"], b["repaired"]):
                fixed = {t: [(x["w"], x["s"]) for x in near] for t, near in (dict(rep) if rep is not None else {}).items()}
                out.append(one(v, list(tokens), fixed))
            yield pd.DataFrame({"v": b["v"], "canonical": out})

    blank = df.where(F.length(plain_spaces(F.col(value))) > 0)
    return repair(blank, value, entries, drop).mapInPandas(ranked, "v string, canonical string").withColumnRenamed("v", value)
