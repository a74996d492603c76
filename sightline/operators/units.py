"""Quantities recorded in different units, converted to one common unit.

A stated quantity is a text such as ``'SAR 12.5 - 14k per month (48 h week)'``. Its
numbers are replaced by ``#``; the rest is segmented by dynamic programming over tries:
prefixes (k, thousand, lakh ...), roots (the currencies) and exponents (per hour ... per
year), plus the small words that join amounts and the phrases whose numbers are no
amounts. Decompositions are scored by covered length; where a writing has several
readings (``pm``, ``12.500``), priors of the field's dimension decide.

The segmentation runs once for each distinct skeleton of an Arrow batch; everything else
(conversion, rounding) is a JVM expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sightline.functions.writing import ascii_digits, plain_spaces
from sightline.session import bounded_broadcast, small_list, spread

# Writings of the currencies (roots).
ROOTS = {
    "SAR": ["sar", "sr", "sr.", "s.r.", "riyal", "riyals", "saudi riyal", "saudi riyals", "﷼", "ر.س", "ر.س.", "ريال", "ريال سعودي"],
    "USD": ["usd", "us$", "$", "us dollar", "us dollars", "dollar", "dollars", "دولار", "دولار أمريكي"],
    "EUR": ["eur", "€", "euro", "euros", "يورو"],
    "GBP": ["gbp", "£", "pound sterling", "pounds sterling", "pound", "pounds", "جنيه إسترليني"],
    "AED": ["aed", "dh", "dhs", "dhs.", "dirham", "dirhams", "د.إ", "د.إ.", "درهم"],
    "KWD": ["kwd", "kd", "kd.", "kuwaiti dinar", "kuwaiti dinars", "د.ك", "د.ك."],
    "BHD": ["bhd", "bd", "bd.", "bahraini dinar", "bahraini dinars", "د.ب", "د.ب."],
    "EGP": ["egp", "le", "l.e.", "e£", "egyptian pound", "egyptian pounds", "ج.م", "ج.م.", "جنيه", "جنيه مصري"],
    "INR": ["inr", "rs", "rs.", "₹", "rupee", "rupees", "indian rupees", "روبية"],
    "QAR": ["qar", "qr", "qr.", "qatari riyal", "qatari riyals", "ر.ق"],
    "OMR": ["omr", "omani rial", "omani rials", "ر.ع"],
    "JOD": ["jod", "jd", "jd.", "jordanian dinar", "jordanian dinars", "د.أ"],
}
# Writings of the scales (prefixes).
PREFIXES = {1000: ["k", "thousand", "thousands", "ألف", "الف", "آلاف"], 100000: ["lakh", "lakhs", "lac", "lacs"], 1000000: ["million", "millions", "mn", "mio", "مليون"], 10000000: ["crore", "crores"]}
# Writings of the periods (exponents); each also stands after "per", "a", "each", "/".
PERIODS = {
    "hour": (["hour", "hr", "h"], ["hourly", "p.h.", "ph", "بالساعة", "في الساعة"]),
    "day": (["day", "diem"], ["daily", "p.d.", "يوميا", "في اليوم"]),
    "week": (["week", "wk", "w"], ["weekly", "p.w.", "pw", "أسبوعيا", "اسبوعيا", "في الأسبوع"]),
    "month": (["month", "mo", "m", "mth"], ["monthly", "p.m.", "pm", "pcm", "p.c.m.", "شهريا", "في الشهر"]),
    "year": (["year", "yr", "annum", "y"], ["yearly", "annually", "annual", "p.a.", "pa", "سنويا", "في السنة"]),
}
BEFORE_PERIOD = ["per ", "a ", "an ", "each ", "every ", "/", "/ ", "per-"]
# Words that join or announce amounts.
JOINING = ["from", "to", "up to", "upto", "between", "and", "min", "min.", "max", "max.", "minimum", "maximum", "-", "–", "—", "~", "/", "approx", "approx.", "circa", "about", "around", "ca.", "basic", "salary", "offer", "pay", "gross", "net", "fixed", "benefits", "housing", "commission", "negotiable", "+", "plus", "(", ")", ",", ":", ";", "."]
# Phrases around numbers that are no amounts ('#' is a number).
ASIDES = ["#%", "# %", "#% commission", "commission #%", "commission # %", "overtime paid at #%", "(# h week)", "# h week", "# hours a week", "# hours per week", "# days a week", "# days per week", "# days leave", "# days", "# air tickets", "# tickets", "# ticket", "#th salary", "# th salary", "#th", "(grade #)", "grade #", "level #", "(# years min)", "# years min", "# years", "# yrs", "# months bonus", "# shifts"]

#: A number with its grouping: blanks, apostrophes, commas or dots between triples.
NUMBER = re.compile(r"\d{1,3}(?:[ '’]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d{1,3}(?:\.\d{3})+,\d{1,2}(?!\d)|\d{1,3}(?:\.\d{3}){2,}(?!\d)|\d+(?:[.,]\d+)?")
#: Prior of the dimension: monthly pay is lognormal around this many SAR with this spread.
PAY_CENTRE, PAY_SPREAD = math.log(8000), 1.2
_SKIP = -1.5


class Trie:
    """Characters to the readings that end there, as (kind, value, score)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, phrase: str, kind: str, value: object, prior: float = 0.0) -> None:
        node = self.root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((kind, value, len(phrase) + prior))

    def ends(self, text: str, at: int) -> Iterable[tuple[int, tuple]]:
        node = self.root
        for i in range(at, len(text)):
            if (node := node.get(text[i])) is None:
                return
            for reading in node.get("", ()):
                yield i + 1, reading


def pay_tries() -> list[Trie]:
    """The tries of prefixes, roots, exponents and of the words around them."""
    prefix, root, exponent, words = Trie(), Trie(), Trie(), Trie()
    for value, names in PREFIXES.items():
        for x in names:
            for lead in ("#", "# "):
                prefix.add(lead + x, "amount", value, 1.0)
    for value, names in ROOTS.items():
        for x in names:
            root.add(x, "root", value)
    for value, (bare, whole) in PERIODS.items():
        for x in whole:
            exponent.add(x, "period", value)
            exponent.add("/" + x, "period", value)
        for x in bare:
            for lead in BEFORE_PERIOD:
                exponent.add(lead + x, "period", value, 0.5)
    for x in JOINING:
        words.add(x, "word", x)
    words.add(" ", "word", " ")
    words.add("#", "amount", 1)
    for x in ASIDES:
        words.add(x, "aside", x, 1.0)
    return [prefix, root, exponent, words]


def _bounded(text: str, i: int, j: int) -> bool:
    """A run of letters may end only where the next character isn't the same word going on."""
    return not (text[j - 1].isalpha() and j < len(text) and text[j].isalpha() and text[j - 1].isascii() == text[j].isascii())


def segment(text: str, tries: list[Trie]) -> tuple[tuple[str, object], ...]:
    """Best decomposition of a skeleton: maximises covered length; words glued together pay a little."""
    n = len(text)
    best: list[tuple[float, int, tuple | None]] = [(0.0, -1, None)] + [(-math.inf, -1, None)] * n
    for i in range(n):
        here = best[i][0]
        if here == -math.inf:
            continue
        if here + _SKIP > best[i + 1][0]:
            best[i + 1] = (here + _SKIP, i, None)
        for trie in tries:
            for j, (kind, value, score) in trie.ends(text, i):
                glued = 0.0 if _bounded(text, i, j) else -0.8
                whole = here + score + glued + (0.2 if i == 0 or not (text[i - 1].isalpha() and text[i].isalpha()) else -0.8)
                if whole > best[j][0]:
                    best[j] = (whole, i, (kind, value))
    out, at = [], n
    while at > 0:
        _, back, what = best[at]
        out.append(what if what else ("unknown", text[back:at]))
        at = back
    return tuple(reversed(out))


@lru_cache(maxsize=1)
def _tries() -> list[Trie]:
    return pay_tries()


@lru_cache(maxsize=100_000)
def _segmented(skeleton: str) -> tuple[tuple[str, object], ...]:
    return segment(skeleton, _tries())


def number_readings(token: str, scaled: bool) -> list[Decimal]:
    """Values a number token can mean: a dot before three digits is open unless scaled, a comma groups them."""
    plain = token.replace(" ", "").replace("'", "").replace("’", "")
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+,\d{1,2}", plain):
        return [Decimal(plain.replace(".", "").replace(",", "."))]
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+\.\d+", plain) or re.fullmatch(r"\d{1,3}(?:,\d{3}){2,}", plain):
        return [Decimal(plain.replace(",", ""))]
    if re.fullmatch(r"\d{1,3}(?:\.\d{3}){2,}", plain):
        return [Decimal(plain.replace(".", ""))]
    if m := re.fullmatch(r"(\d{1,3})([.,])(\d{3})", plain):
        grouped, fraction = Decimal(m[1] + m[3]), Decimal(f"{m[1]}.{m[3]}")
        return [grouped] if m[2] == "," else [fraction] if scaled else [grouped, fraction]
    return [Decimal(plain.replace(",", "."))]


def parse_quantity(text: str | None, rates: Mapping[str, float], factors: Mapping[str, float]) -> tuple[str | None, str | None, str | None, str | None]:
    """(lowest, highest, root, period) of a text; amounts as decimal strings, None where not stated.

    ``text`` is lower case with ASCII digits and single blanks. Scales of the last amount hold
    for those before it where they have none and the order of the amounts stays. All amounts
    count, however many. Null, blank and texts without amounts give None; a text of any
    length is read whole.
    """
    if not text:
        return None, None, None, None
    tokens = NUMBER.findall(text)
    parts = _segmented(NUMBER.sub("#", text))
    root = next((v for k, v in parts if k == "root"), None)
    period = next((v for k, v in parts if k == "period"), None)
    amounts, at = [], 0
    for kind, value in parts:
        if kind == "aside":
            at += str(value).count("#")
        elif kind == "amount":
            amounts.append((tokens[at], int(value)))
            at += 1
        elif kind == "unknown" and value == "#":
            at += 1
    if not amounts:
        return None, None, root, period
    per_month = (rates.get(root or "SAR", 1.0) * factors.get(period or "month", 12.0)) / 12
    values = []
    for token, scale in amounts:
        options = number_readings(token, scale != 1)
        pay = lambda v, s=scale: abs(math.log(max(float(v) * s * per_month, 1e-9)) - PAY_CENTRE) / PAY_SPREAD
        values.append(min(options, key=pay))
    scales = [s for _, s in amounts]
    if len(values) > 1 and scales[-1] != 1:
        scales = [scales[-1] if s == 1 and v <= values[-1] else s for v, s in zip(values, scales)]
    stated = [v * s for v, s in zip(values, scales)]
    low, high = min(stated), max(stated)
    return format(low, "f"), format(high, "f"), root, period


def quantity(text: Column, rates: Mapping[str, float], factors: Mapping[str, float]) -> Column:
    """Struct (low, high decimal(18,4), root, period) of a text, by :func:`parse_quantity`."""
    rates, factors = dict(rates), dict(factors)

    @pandas_udf("low string, high string, root string, period string")
    def parse(s: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = [known[x] if x in known else known.setdefault(x, parse_quantity(x, rates, factors)) for x in s]
        return pd.DataFrame(rows, columns=["low", "high", "root", "period"])

    marks = F.regexp_replace(F.translate(ascii_digits(text), "٫٬ـ", ".,"), "[ً-ْ]", "")
    return parse(F.lower(plain_spaces(marks)))


def to_common_unit(df: DataFrame, key: list[str], text: str, root: str, period: str, low: str, high: str, rates: DataFrame, factors: DataFrame) -> DataFrame:
    """One row per distinct (key, low, high) in units of the rate table per twelfth of a year.

    ``rates`` (currency, sar_per_unit) and ``factors`` (salary_period, periods_per_year) are
    reference lists of fixed size; they parametrise the priors and are joined, broadcast
    after a check of their size. A unit in the text goes before the column; the columns'
    amounts count only where the text has none. Incomplete rows give no row; ties and
    repeated rows collapse; an empty table gives an empty one.
    """
    fixed_rates = {r[0]: float(r[1]) for r in small_list(rates.select("currency", "sar_per_unit"), 1000, "the table of rates")}
    fixed_factors = {r[0]: float(r[1]) for r in small_list(factors.select("salary_period", "periods_per_year"), 1000, "the table of periods")}
    q = lambda c: quantity(F.col(c), fixed_rates, fixed_factors)
    fields = df.select(*key, F.col(text).alias("_text"), F.col(root).alias("_root"), F.col(period).alias("_period"), F.nanvl(F.col(low), F.lit(None)).cast("decimal(18,4)").alias("_low"), F.nanvl(F.col(high), F.lit(None)).cast("decimal(18,4)").alias("_high"))
    read = spread(fields).withColumn("_q", q("_text"))
    # The unit columns hold few distinct values: each is read once.
    # A period's column may hold the bare word, which in a text stands after "per".
    units = lambda c: bounded_broadcast(fields.select(c).distinct().withColumn(f"{c}_q", quantity(F.concat(F.lit("per "), F.col(c)) if c == "_period" else F.col(c), fixed_rates, fixed_factors)))
    read = read.join(units("_root"), "_root", "left").join(units("_period"), "_period", "left")
    has = F.col("_q.low").isNotNull()
    a = F.when(has, F.col("_q.low").cast("decimal(18,4)")).otherwise(F.coalesce("_low", "_high"))
    b = F.when(has, F.col("_q.high").cast("decimal(18,4)")).otherwise(F.coalesce("_high", "_low"))
    stated = read.select(*key, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), F.coalesce(F.col("_q.root"), F.col("_root_q.root")).alias("currency"), F.coalesce(F.col("_q.period"), F.col("_period_q.period")).alias("salary_period"))
    stated = stated.where(F.col("_a").isNotNull() & F.col("currency").isNotNull() & F.col("salary_period").isNotNull())
    joined = stated.join(bounded_broadcast(rates.select("currency", F.col("sar_per_unit").cast("decimal(12,6)").alias("_rate"))), "currency").join(bounded_broadcast(factors.select("salary_period", F.col("periods_per_year").cast("decimal(6,0)").alias("_per"))), "salary_period")
    half_up = lambda c: F.expr(f"(({c} * _rate * _per) + 6) div 12")
    return joined.select(*key, half_up("_a").cast("long").alias("min_common"), half_up("_b").cast("long").alias("max_common")).distinct()


def states_amount(text: Column) -> Column:
    """Whether a text holds a number that is an amount: one outside the phrases of :data:`ASIDES`."""
    number = r"\d+(?:[.,]\d+)?"
    asides = "|".join(sorted((re.escape(a).replace(re.escape("#"), number).replace(r"\ ", r"\s*") for a in ASIDES), key=len, reverse=True))
    return F.regexp_replace(F.lower(plain_spaces(ascii_digits(text))), asides, " ").rlike(r"\d")
