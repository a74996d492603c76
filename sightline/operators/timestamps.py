"""Mixed timestamp writings to one UTC instant.

Every value is read under each interpretation it admits (year first, day first, month
first, epoch, named month). Where more than one reading is valid, a mixture of formats
per source decides: the values of a source contribute the likelihood of each valid
reading, expectation-maximisation fits the weights of the mixture, and the posterior
chooses the reading. Values whose posterior stays below ``certain`` are marked as
ambiguous; a declared order of the source enters as a prior.

All steps are JVM expressions. Only one row per source and signature (at most eight
signatures) is shuffled for the fit, and the fitted weights are one row per source.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.writing import ascii_digits, plain_spaces
from sightline.session import cut_table

# Month names by number, English and Arabic (both Arabic namings).
MONTHS = {
    1: ["jan", "january", "يناير", "كانون الثاني"], 2: ["feb", "february", "فبراير", "شباط"], 3: ["mar", "march", "مارس", "آذار"],
    4: ["apr", "april", "أبريل", "ابريل", "إبريل", "نيسان"], 5: ["may", "مايو", "أيار"], 6: ["jun", "june", "يونيو", "حزيران"],
    7: ["jul", "july", "يوليو", "تموز"], 8: ["aug", "august", "أغسطس", "اغسطس", "آب"], 9: ["sep", "sept", "september", "سبتمبر", "أيلول"],
    10: ["oct", "october", "أكتوبر", "اكتوبر", "تشرين الأول"], 11: ["nov", "november", "نوفمبر", "تشرين الثاني"], 12: ["dec", "december", "ديسمبر", "كانون الأول"],
}
# Zone abbreviations in use, in minutes east of UTC.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "ast": 180, "gst": 240, "pkt": 300, "ist": 330, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}

_ZONES = sorted(z for z in available_timezones() if "/" in z and not z.startswith(("SystemV/", "posix/", "right/", "Etc/")))
_WORD = r"[\p{L}]{3,12}(?: [\p{L}]{4,6})?\.?"
_DATE = rf"\d{{8}}|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{4}}[- ]{_WORD}[- ]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2}}|\d{{1,2}}[-/. ]{_WORD}[-/. ,]+(?:\d{{4}}|\d{{2}})|{_WORD} \d{{1,2}},? \d{{4}}"
_TIME = r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)? ?([ap]\.?m\.?(?![a-z]))?"
_ZONE = r"z|(?:utc|gmt)? ?[+\-−]\d{1,2}:?(?:\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z_\-]+){1,2}"
_FULL = rf"^(?:\p{{L}}{{2,9}}\.?, )?({_DATE})(?:(?:t|,? ){_TIME})? ?({_ZONE})?(?: ?\[([a-z]+(?:/[a-z_\-]+){{1,2}})\])?$"
_EPOCH = r"^(?:/date\()?(\d{10}|\d{13}|\d{16}|\d{19})(?:[+-]\d{4})?(?:\)/)?$"
#: Readings of a date, in the order of the arrays below.
READINGS = ("ymd", "dmy", "mdy")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _micros(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def _map(pairs: dict) -> Column:
    """A constant map, given as two joined strings so that the plan holds one small node."""
    keys, values = "|".join(map(str, pairs)), "|".join(map(str, pairs.values()))
    return F.map_from_arrays(F.split(F.lit(keys), r"\|"), F.split(F.lit(values), r"\|"))


def with_readings(df: DataFrame, value: str, zone: str) -> DataFrame:
    """Adds ``_r``, the struct of a value's valid readings.

    ``fixed``: microseconds where only one reading can exist (epochs, named months);
    ``by``: array of microseconds under each of :data:`READINGS`, null where invalid.
    Null, blank and unreadable values give nulls throughout; a text of any length is safe.
    Built in steps, each a projection of its own, so that no step is computed twice.
    """
    v = F.lower(plain_spaces(ascii_digits(F.col(value))))
    df = df.withColumn("_v", v)
    # One match per value: the groups, joined by a control character, are split again.
    groups = F.when(F.col("_v").rlike(_FULL), F.split(F.regexp_replace("_v", _FULL, "\u0001".join(f"${i}" for i in range(1, 9))), "\u0001"))
    df = df.withColumn("_g", groups).withColumn("_e", F.regexp_extract("_v", _EPOCH, 1))
    part = [F.nullif(F.get(F.col("_g"), F.lit(i)), F.lit("")) for i in range(8)]
    date, hh, mi, ss, frac, half, offset, bracket = part
    token = F.filter(F.split(date, r"(?<=\d)[-/., ]+|[-/., ]+(?=\d)"), lambda x: x != "")
    h = _int(hh)
    hour = F.when(half.isNull(), F.coalesce(h, F.lit(0))).when((h >= 1) & (h <= 12), h % 12 + F.when(half.startswith("p"), 12).otherwise(0))
    second = F.concat(F.coalesce(ss, F.lit("0")), F.lit("."), F.rpad(F.coalesce(F.substring(frac, 1, 6), F.lit("0")), 6, "0")).try_cast("decimal(8,6)")
    df = df.withColumn("_d", date).withColumn("_t", token).withColumn("_h", hour).withColumn("_n", F.coalesce(_int(mi), F.lit(0))).withColumn("_s", second).withColumn("_z", offset).withColumn("_clock", hh.isNotNull()).withColumn("_bracket", bracket)

    z = F.col("_z")
    digits = F.regexp_replace(F.regexp_extract(z, r"[+\-−](\d{1,2}:?(?:\d{2})?)$", 1), ":", "")
    digits = F.when(F.length(digits) <= 2, F.rpad(F.lpad(digits, 2, "0"), 4, "0")).otherwise(F.lpad(digits, 4, "0"))
    minutes = F.when(z.rlike(r"[+\-−]\d"), F.when(z.rlike(r"[-−]\d"), -1).otherwise(1) * (_int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2)))).otherwise(_int(F.try_element_at(_map(ABBREVIATIONS), z)))
    stated = F.when(z.contains("/"), z).when(z.isNull(), F.coalesce("_bracket", F.when(F.col("_clock"), F.col(zone))))
    df = df.withColumn("_min", minutes).withColumn("_region", F.try_element_at(_map({x.lower(): x for x in _ZONES}), F.lower(stated))).withColumn("_stated", stated.isNotNull())
    valid = F.when(F.col("_stated"), F.col("_region").isNotNull()).otherwise(z.isNull() | F.col("_min").isNotNull())
    month_of = _map({name: n for n, names in MONTHS.items() for name in names})
    named = lambda i: _int(F.try_element_at(month_of, F.regexp_replace(F.get(F.col("_t"), F.lit(i)), r"\.$", "")))
    df = df.withColumn("_ok", valid).withColumn("_m0", named(0)).withColumn("_m1", named(1))

    t = [F.get(F.col("_t"), F.lit(i)) for i in range(3)]
    year = lambda x: F.when(F.length(x) == 4, _int(x)).when(F.length(x) == 2, _int(x) + 2000)
    compact = F.col("_d").rlike(r"^\d{8}$")
    sub = lambda a, n: _int(F.substring("_d", a, n))
    # Year, month and day under each reading, then the four moments.
    ymd = F.when(compact, F.array(sub(1, 4), sub(5, 2), sub(7, 2))).when(F.length(t[0]) == 4, F.array(_int(t[0]), _int(t[1]), _int(t[2])))
    is_ymd8 = F.try_make_timestamp_ntz(sub(1, 4), sub(5, 2), sub(7, 2), F.lit(0), F.lit(0), F.lit(0)).isNotNull() & sub(1, 4).between(1900, 2200)
    parts = (F.size("_t") == 3) & (F.length(t[0]) <= 2)
    dmy = F.when(compact & ~is_ymd8, F.array(sub(5, 4), sub(3, 2), sub(1, 2))).when(~compact & parts, F.array(year(t[2]), _int(t[1]), _int(t[0])))
    mdy = F.when(compact & ~is_ymd8, F.array(sub(5, 4), sub(1, 2), sub(3, 2))).when(~compact & parts, F.array(year(t[2]), _int(t[0]), _int(t[1])))
    word = F.when(F.col("_m1").isNotNull(), F.when(F.length(t[0]) == 4, F.array(_int(t[0]), F.col("_m1"), _int(t[2]))).otherwise(F.array(year(t[2]), F.col("_m1"), _int(t[0])))).when(F.col("_m0").isNotNull(), F.array(year(t[2]), F.col("_m0"), _int(t[1])))
    df = df.withColumn("_days", F.array(ymd, dmy, mdy, word))

    def moment(d: Column) -> Column:
        clock = F.try_make_timestamp_ntz(F.get(d, F.lit(0)), F.get(d, F.lit(1)), F.get(d, F.lit(2)), F.col("_h"), F.col("_n"), F.col("_s"))
        utc = F.when(F.col("_region").isNotNull(), F.convert_timezone(F.col("_region"), F.lit("UTC"), clock)).otherwise(clock)
        return F.when(F.col("_ok") & F.get(d, F.lit(0)).between(1900, 2200), _micros(utc) - F.coalesce("_min", F.lit(0)).cast("long") * 60000000)

    e = F.col("_e").try_cast("decimal(20,0)")
    n = F.length("_e")
    epoch = F.when(n == 10, e * 1000000).when(n == 13, e * 1000).when(n == 16, e).when(n == 19, F.floor(e / 1000)).cast("long")
    df = df.withColumn("_x", F.transform("_days", moment))
    out = F.struct(F.coalesce(epoch, F.get("_x", F.lit(3))).alias("fixed"), F.slice("_x", 1, 3).alias("by"))
    return df.withColumn("_r", out).drop("_v", "_g", "_e", "_d", "_t", "_h", "_n", "_s", "_z", "_clock", "_bracket", "_min", "_region", "_stated", "_ok", "_m0", "_m1", "_days", "_x")


def _lateness(seen: str | None) -> Callable[[Column], Column]:
    """Likelihood of a moment given when it was seen: later ones are a hundred times less likely."""
    if seen is None:
        return lambda _: F.lit(1.0)
    return lambda x: F.when(F.col(seen).isNull() | (x <= F.unix_micros(F.col(seen)) + 86400000000), 1.0).otherwise(0.01)


def fit_format_mixture(df: DataFrame, source: list[str], by: str, declared: str, seen: str | None = None, prior: float = 1000.0, rounds: int = 20) -> DataFrame:
    """Weights of the date readings per source by expectation-maximisation.

    ``by`` holds the array of :func:`with_readings`; ``declared`` the source's stated order (or
    null); ``seen`` a timestamp by which the moment must have passed, which makes later
    readings a hundred times less likely. A value's signature is its vector of
    likelihoods; only counts of signatures per source are shuffled. Result: one row per
    source with ``weights`` (array in the order of READINGS). Sources of no dated values
    give the prior alone.
    """
    late = _lateness(seen)
    likelihood = F.transform(F.col(by), lambda x: F.when(x.isNull(), 0.0).otherwise(late(x)))
    counts = df.select(*source, F.col(declared).alias("_o"), likelihood.alias("_l")).groupBy(*source, "_l").agg(F.max("_o").alias("_o"), F.count(F.lit(1)).cast("double").alias("_n"))
    per = counts.groupBy(*source).agg(F.max("_o").alias("_o"), F.collect_list(F.struct("_l", "_n")).alias("_s"))
    alpha = F.array(*[F.when(F.col("_o") == r, prior).otherwise(1.0) for r in READINGS])
    start = F.transform(F.col("_a"), lambda x: x / F.aggregate(F.col("_a"), F.lit(0.0), lambda a, y: a + y))

    def step(w: Column, _: Column) -> Column:
        def gathered(acc: Column, s: Column) -> Column:
            joint = F.zip_with(w, s["_l"], lambda a, b: a * b)
            total = F.aggregate(joint, F.lit(0.0), lambda a, y: a + y)
            return F.zip_with(acc, joint, lambda a, y: a + F.when(total > 0, y / total * s["_n"]).otherwise(0.0))

        new = F.aggregate(F.col("_s"), F.col("_a"), gathered)
        return F.transform(new, lambda x: x / F.aggregate(new, F.lit(0.0), lambda a, y: a + y))

    return per.withColumn("_a", alpha).select(*source, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("weights"))


def to_utc(df: DataFrame, value: str, source: list[str], zone: str, declared: str, seen: str | None = None, certain: float = 0.9) -> DataFrame:
    """Adds ``utc_us`` (long), ``reading``, ``posterior`` and ``is_ambiguous`` to ``df``.

    ``zone`` names the column with the source's zone for clock readings without one, of a
    clock reading that occurs twice the first is taken, and a date alone is midnight UTC.
    Null, blank, invalid and relative wordings give nulls. Columns of ``df`` are kept; the
    added names win over columns of the same name. Rows keep their number.
    """
    kept = [c for c in df.columns if c not in ("utc_us", "reading", "posterior", "is_ambiguous")]
    names = [f"s{i}" for i in range(len(source))]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(value).cast("string").alias("written"), F.col(zone).alias("zone"), F.col(declared).alias("declared"), (F.col(seen) if seen else F.lit(None)).cast("timestamp").alias("seen"), *[F.col(c).alias(n) for c, n in zip(source, names)])
    # Read twice, and a barrier: a filter pushed down would repeat the parse in every predicate.
    read = cut_table(with_readings(base, "written", "zone"), "readings")
    dated = read.where(F.col("_r.fixed").isNull() & F.exists(F.col("_r.by"), lambda x: x.isNotNull())).withColumn("by", F.col("_r.by"))
    weights = fit_format_mixture(dated, names, "by", "declared", "seen" if seen else None).select(*[F.col(n).alias(f"w_{n}") for n in names], "weights")
    out = read.join(weights, [F.col(n).eqNullSafe(F.col(f"w_{n}")) for n in names], "left")
    late = _lateness("seen" if seen else None)
    mass = F.zip_with(F.col("_r.by"), F.col("weights"), lambda x, w: F.when(x.isNull(), 0.0).otherwise(w * late(x)))
    out = out.withColumn("mass", mass).withColumn("total", F.aggregate(F.col("mass"), F.lit(0.0), lambda a, x: a + x))
    best = F.array_max(F.col("mass"))
    pick = F.array_position(F.col("mass"), best).cast("int") - 1
    agreed = F.size(F.array_distinct(F.filter(F.col("_r.by"), lambda x: x.isNotNull()))) == 1
    by_mass = F.col("_r.fixed").isNull() & (F.col("total") > 0)
    posterior = F.when(F.col("_r.fixed").isNotNull() | (by_mass & agreed), 1.0).when(by_mass, best / F.col("total"))
    return out.select(
        "row.*",
        F.coalesce(F.col("_r.fixed"), F.when(by_mass, F.get(F.col("_r.by"), pick))).alias("utc_us"),
        F.when(F.col("_r.fixed").isNotNull(), "fixed").when(by_mass, F.get(F.array(*map(F.lit, READINGS)), pick)).alias("reading"),
        posterior.alias("posterior"),
        F.coalesce(posterior < certain, F.lit(False)).alias("is_ambiguous"),
    )
