"""Text keys as Column expressions; word lists are parameters with the engine's defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hiring noise, company noise and title abbreviations of the matching keys.
TITLE_NOISE = ["urgent", "urgently", "hiring", "required", "needed", "wanted", "immediate", "saudi national", "saudi nationals", "saudis only", "saudi only", "ksa", "saudi arabia", "saudi", "riyadh", "jeddah", "dammam", "khobar", "al khobar"]
COMPANY_NOISE = ["company", "co", "ltd", "limited", "inc", "llc", "plc", "corp", "corporation", "group", "est", "establishment", "the", "careers page", "careers", "jobs", "ksa", "saudi arabia", "kingdom of saudi arabia", "شركة", "مؤسسة"]
TITLE_SHORT = {"sr": "senior", "jr": "junior", "mgr": "manager"}
TITLE_MARKS = "–—‐‑‒―’‘“”«»•·…،؛؟"
# Words of rank in their order, and what some of them count as.
LEVEL_WORDS = ["intern", "internship", "trainee", "apprentice", "assistant", "associate", "junior", "senior", "lead", "head", "principal", "manager", "director", "chief", "deputy", "vice", "demi", "ii", "iii", "iv", "2", "3", "4"]
LEVEL_LABELS = {"internship": "intern", "2": "ii", "3": "iii", "4": "iv"}
# Employment types by their writing without hyphens and blanks.
EMPLOYMENT_TYPES = {"fulltime": "Full-time", "parttime": "Part-time", "contract": "Contract", "contractor": "Contract", "intern": "Internship", "internship": "Internship", "temporary": "Temporary", "volunteer": "Volunteer", "other": "Other"}


def clean(c: Column) -> Column:
    """Blank to null, outer spaces off."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case, ASCII punctuation to blanks, white space collapsed, null if nothing is left."""
    return clean(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{Punct}", " "), r"\s+", " "))


def remove_words(c: Column, noise: list[str]) -> Column:
    """Whole words and phrases removed in two passes; a run of more than three may leave one."""
    pattern = f" ({'|'.join(noise)}) "
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return clean(F.regexp_replace(F.regexp_replace(F.regexp_replace(padded, pattern, " "), pattern, " "), r"\s+", " "))


def normalize_title(c: Column, noise: list[str] = TITLE_NOISE) -> Column:
    """Title key: '&' is 'and', bracketed notes off unless nothing else is there, noise words off."""
    prepared = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), f"[{TITLE_MARKS}]", " ")
    base = F.coalesce(normalize_text(F.regexp_replace(prepared, r"\([^)]*\)|\[[^\]]*\]", " ")), normalize_text(prepared))
    padded = F.concat(F.lit(" "), base, F.lit(" "))
    for short, long in TITLE_SHORT.items():
        padded = F.regexp_replace(padded, f" {short} ", f" {long} ")
    return remove_words(padded, noise)


def normalize_company(c: Column, noise: list[str] = COMPANY_NOISE) -> Column:
    """Company key: legal suffixes and page labels off."""
    return remove_words(normalize_text(c), noise)


def strip_html(c: Column) -> Column:
    """Markup to text: entities, then tags, then entities that were escaped twice."""
    first = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    last = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
    put = lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1]))
    bare = F.regexp_replace(reduce(put, first, c), "<[^>]*>", " ")
    return clean(F.regexp_replace(reduce(put, last, bare), r"\s+", " "))


def normalize_employment_type(c: Column) -> Column:
    """One vocabulary; combined values are their own, unknown ones pass through to be noticed."""
    low = F.lower(c)
    key = F.lower(F.replace(F.replace(F.trim(c), F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    out = F.when(low.like("%full%time%") & low.like("%part%time%"), "Full-time and Part-time").when(low.like("% and %") | c.like("%,%"), "Other")
    for written, value in EMPLOYMENT_TYPES.items():
        out = out.when(key == written, value)
    return out.otherwise(clean(c))


def has_word(text: Column, word: Column | str) -> Column:
    """Whole-word containment in a normalised text."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))


def level_signature(c: Column, words: list[str] = LEVEL_WORDS) -> Column:
    """The words of rank a title holds, in a fixed order, as one string."""
    return F.concat(*[F.when(has_word(c, w), f"{LEVEL_LABELS.get(w, w)} ").otherwise("") for w in words])


def publisher_key(c: Column, source: Column) -> Column:
    """Publisher without 'www.' and domain ending, letters and digits only."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^www\.|\.(com|net|org|io|co|sa)$", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"[\s\p{Punct}]", ""), F.lit("")), F.concat(source, F.lit(":unknown")))


def in_scope(country: Column, texts: list[Column], name: str, patterns: list[str]) -> Column:
    """Structured first: the country if one is stated, else whether a text is like any pattern."""
    stated = clean(country)
    said = reduce(lambda a, b: a | b, [F.coalesce(F.lower(t).like(p.lower()), F.lit(False)) for t in texts for p in patterns])
    return F.when(stated.isNotNull(), F.lower(stated) == name.lower()).otherwise(said)


def workplace_type(stated: Column, remote: Column, hybrid: Column | None = None) -> Column:
    """The stated type, else what the flags of a feed say; 'Unknown' where neither does."""
    flags = F.when(remote, "Remote")
    if hybrid is not None:
        flags = F.when(hybrid, "Hybrid").when(remote, "Remote").when(~remote & ~hybrid, "OnSite")
    return F.coalesce(F.when(F.lower(stated) != "unknown", clean(stated)), flags, F.lit("Unknown"))


def remote_status(workplace: Column, remote: Column) -> Column:
    """The type goes before the flag: Remote, Hybrid, On-site or Unknown."""
    low = F.lower(F.replace(workplace, F.lit("-"), F.lit("")))
    return F.when(low == "remote", "Remote").when(low == "hybrid", "Hybrid").when(low == "onsite", "On-site").when(remote, "Remote").when(~remote, "On-site").otherwise("Unknown")


def nth_match(c: Column, pattern: str, n: int, group: int = 0) -> Column:
    """The n-th match of a pattern (from 1), null where there are fewer."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(n - 1))


def matches_whole(c: Column, pattern: str) -> Column:
    """Whether a pattern covers the whole text."""
    return c.rlike(f"^(?:{pattern})$")
