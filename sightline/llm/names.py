"""Variant spellings of names typed by people, resolved by merge and rematch.

A profile unites what is known of an organisation: the spellings of its distinctive
name, the words of its line of business, its initials. Profiles begin with the spellings of
the reference list, to which names are merged that agree letter for letter (folded across
scripts). What is left enters blocking over deletion keys of the profiles' spellings and is
merged into the profile it matches; the merged records' spellings and initials then belong
to the profile, which enters blocking again, until a round merges nothing. A name matches a
profile if its distinctive word does and the rest of it is the line of business, spelled
out, abbreviated or left out; another line of business is another organisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.spelling import LongVocabulary, Vocabulary, allowed, deletions, distance, fold, forms, is_arabic, words
from sightline.session import bounded_broadcast, cut_table, small_list

# Legal forms and the remarks that feeds put beside a name.
LEGAL = {"ltd", "limited", "co", "company", "llc", "wll", "est", "establishment", "inc", "incorporated", "corp", "corporation", "group", "holding", "gmbh", "plc", "شركة", "شركه", "مجموعة", "مجموعه", "مؤسسة", "مؤسسه", "المحدودة", "المحدوده"}
REMARKS = {"careers", "career", "jobs", "job", "hiring", "page", "branch", "office", "main", "head", "hq", "eastern", "western", "northern", "southern", "central", "ksa", "saudi", "arabia", "at", "the", "and", "وظائف", "فرع", "السعودية", "الرياض", "جدة"}
ARTICLES = {"al", "el", "a1", "ال"}
#: Stands before initials where they are compared among spellings.
MARK = "="
_DOTTED = re.compile(r"\b(l\.?\s?l\.?\s?c|w\.?\s?l\.?\s?l)\b\.?", re.I)
_TITLE = re.compile(r"\bm/s\b\.?", re.I)
_INITIALS = re.compile(r"(?<![\w.])(?:[A-Z]\.){2,5}(?!\w)|(?<![\w.])[A-Z]{2,5}(?![\w.])")


def bare(name: str) -> str:
    """A name without the title before it and without dotted legal forms."""
    return _DOTTED.sub(" ", _TITLE.sub(" ", name))


def core(name: str) -> list[str]:
    """Words of a name without legal forms, remarks, numbers and articles."""
    out = [w for w in words(bare(name)) if w not in LEGAL and w not in REMARKS and not w.isdigit()]
    kept = [w for w in out if w not in ARTICLES]
    return [w[2:] if is_arabic(w) and w.startswith("ال") and len(w) > 5 else w for w in kept]


def initials_of(name: str, standard: list[str]) -> str | None:
    """The initials of a name written out in the order of its standard, with the article before it; None for others."""
    w = [x for x in words(bare(name)) if x not in LEGAL and x not in REMARKS and not x.isdigit() and x != "and"]
    usual = "".join(x[0] for x in standard)
    return w[0][0] + usual if len(w) == len(usual) + 1 <= 5 and w[0] in ARTICLES and "".join(x[0] for x in w[1:]) == usual else None


def as_initials(name: str) -> str | None:
    """The letters of a name that consists of initials alone."""
    letters = "".join(core(name))
    return letters if 2 <= len(letters) <= 5 and any(letters == x.replace(".", "").lower() for x in _INITIALS.findall(bare(name))) else None


def abbreviates(short: str, word: str) -> bool:
    """Same first letter, fewer letters, all of them in order in the word (svcs, mgmt, edu)."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in short)


def bared(word: str) -> str:
    """A word without an article that is glued to it."""
    return word[2:] if word.startswith("al") and len(word) > 6 else word


class Profiles:
    """What is known of every organisation of a reference list (of fixed size)."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.first: dict[str, set[str]] = {}
        self.business: dict[str, tuple[str, ...]] = {}
        self.standard: dict[str, list[str]] = {}
        for std in sorted({s for _, s in rows}):
            w = core(std)
            if w:
                self.standard[std] = w
                self.business[std] = tuple(w[1:])
                self.first.setdefault(fold(w[0]), set()).add(std)
        # The Arabic words of a line of business are learned from the aliases that use them.
        self.foreign: dict[tuple[str, ...], set[str]] = {}
        runs: dict[str, set[str]] = {}
        written = {w[0] for w in self.standard.values()}
        for alias, std in rows:
            if std not in self.standard:
                continue
            w = core(alias)
            if len(w) > 1 and is_arabic(alias):
                self.foreign.setdefault(self.business[std], set()).update(w[1:])
            if len(w) > 1 and not is_arabic(alias):
                written.add(w[0]) if fold(w[0]) in self.first else None
        for std, w in self.standard.items():
            for run in {"".join(w), "and".join(["".join(w[:-1]), w[-1]]) if len(w) > 2 else "".join(w)}:
                for lead in ("", "al"):
                    runs.setdefault(fold(lead + run), set()).add(std)
        self.runs = runs
        self.names = Vocabulary(written)
        self.run_words = LongVocabulary({lead + "".join(w) for w in self.standard.values() for lead in ("", "al") if len(w) > 1} | {lead + "".join(w[:-1]) + "and" + w[-1] for w in self.standard.values() for lead in ("", "al") if len(w) > 2})
        self.trade = Vocabulary({x for b in self.business.values() for x in b} | {x for s in self.foreign.values() for x in s})
        self.initials: dict[str, set[str]] = {}
        for std, w in self.standard.items():
            if len(w) > 1:
                self.initials.setdefault("".join(x[0] for x in w), set()).add(std)
        self.trade_words: dict[str, set[str]] = {}
        for x in {x for b in self.business.values() for x in b}:
            self.trade_words.setdefault(x[0], set()).add(x)
        self.memo: dict[tuple[bool, str], list[tuple[str, float]]] = {}

    def _near(self, is_name: bool, word: str) -> list[tuple[str, float]]:
        if (is_name, word) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[is_name, word] = (self.names if is_name else self.trade).near(word)
        return self.memo[is_name, word]

    def near_name(self, word: str) -> list[tuple[str, float]]:
        return self._near(True, word)

    def near_trade(self, word: str) -> list[tuple[str, float]]:
        return self._near(False, word)

    def business_of(self, std: str) -> set[str]:
        return set(self.business[std]) | self.foreign.get(self.business[std], set())

    def is_trade(self, word: str) -> bool:
        """Whether a word belongs to some line of business."""
        return bool(self.near_trade(word)) or any(abbreviates(word, x) for x in self.trade_words.get(word[0], ()))

    def agrees(self, rest: list[str], std: str) -> float:
        """Share of the line's words that the rest of a name states; -1 if it states something else."""
        if not rest:
            return 0.0
        own = self.business_of(std)
        folded = {fold(x) for x in own}
        options = []
        for w in dict.fromkeys(rest):
            near = {n for n, _ in self.near_trade(w)} & folded
            options.append(near or {fold(x) for x in own if abbreviates(w, x)})

        def placed(i: int, used: frozenset[str]) -> bool:
            """Each word of the rest stands for another word of the line."""
            return i == len(options) or any(placed(i + 1, used | {x}) for x in options[i] - used)

        if len(options) > len(own) or not placed(0, frozenset()):
            return -1.0
        return len(options) / max(1, len(self.business[std]))

    def opened(self, run: str) -> list[str]:
        """A glued run as a known name and the beginning of its line of business, if it is one."""
        for lead in ("", "al"):
            for cut in range(len(lead) + 5, len(run) - 2):
                if run.startswith(lead) and (known := self.first.get(fold(run[len(lead) : cut]))):
                    rest = run[cut:]
                    if any(rest[0] == b[0][0] and abbreviates(rest, "".join(b)) for std in known if (b := self.business[std])):
                        return [run[len(lead) : cut], *self._parts(rest, known)]
        return [run]

    def _parts(self, rest: str, known: set[str]) -> list[str]:
        """The pieces of glued abbreviations, word by word of a line of business."""
        for std in sorted(known):
            b = self.business[std]
            if len(b) == 1 and abbreviates(rest, b[0]):
                return [rest]
            for i in range(1, len(rest)):
                two = [rest[:i], rest[i:]]
                if len(b) >= 2 and all(p == w or abbreviates(p, w) for p, w in zip(two, (b[0], b[-1]))):
                    return two
        return [rest]

    def same_name(self, word: str) -> list[tuple[str, float]]:
        """The listed names of which a word is a spelling letter for letter, folded."""
        return sorted({(n, 1.0) for form in forms(word) for n in self.names.names.get(form, ())})

    def glued(self, word: str) -> list[str]:
        """The organisations whose run-together name stands within two edits of a long word."""
        return sorted({s for n, _ in self.run_words.near(word) for s in self.runs.get(n, ())}) if len(word) >= 9 else []

    def spellings(self) -> list[tuple[str, str]]:
        """(spelling, organisation): what profiles know before any merge."""
        return sorted({(x, std) for x in self.names.names for n in self.names.names[x] for std in self.first.get(n, ())})

    def match(self, name: str, exact: bool = False) -> tuple[str, list[str], list[str]]:
        """(state, organisations, words): state is 'one', 'open' (several fit), or 'none'.

        ``exact`` takes distinctive words letter for letter; else they may carry typos.
        """
        w = core(name)
        if not w:
            return "none", [], []
        if (letters := as_initials(name)) and letters in self.initials:
            found = sorted(self.initials[letters])
            return ("one" if len(found) == 1 else "open"), found, w
        if len(w) == 1 and not exact and (run := self.glued(w[0])):
            return ("one" if len(run) == 1 else "open"), run, w
        if len(w) == 1:
            w = self.opened(w[0])
        near = self.same_name if exact else self.near_name
        state, best = self.decide(w, {x: [(std, sim) for n, sim in {*near(x), *near(bared(x))} for std in self.first.get(n, ())] for x in w})
        return state, best, w

    def decide(self, w: list[str], near: dict[str, list[tuple[str, float]]], least: float = 0.0) -> tuple[str, list[str]]:
        """(state, organisations) of a name's words, of which ``near`` are (organisation, similarity) of each."""
        fits: dict[str, tuple[float, float]] = {}
        for i, x in enumerate(w):
            for std, sim in near.get(x, ()):
                share = 1.0 if x[0] == MARK else self.agrees(w[:i] + w[i + 1 :], std)
                if share >= least:
                    fits[std] = max(fits.get(std, (0.0, 0.0)), (sim, share))
        if not fits:
            return "none", []
        top = max(fits.values())
        best = sorted(s for s, v in fits.items() if v[0] == top[0] and (v[1] > 0) == (top[1] > 0))
        return ("one" if len(best) == 1 else "open"), best


def resolve_names(df: DataFrame, key: str, name: str, aliases: DataFrame, text: str | None = None, unknown: str = "Unknown", most: int = 100_000, rematch: bool = True) -> DataFrame:
    """(key, company_std) of each row whose name means a listed organisation under another spelling.

    Names equal to an alias or standard letter for letter have no row, nor have null, blank
    and stand-in names (those whose standard is ``unknown``) and names of unlisted
    organisations. ``aliases`` (alias, company_std) is a reference list of at most ``most``
    rows; a longer one is an error. Where initials or a bare name fit several organisations, a
    mention of one of them in ``text`` decides, else nothing is claimed. Work is done once per
    distinct name, so a name that a third of all rows carry is one row until the last join.
    Repeated rows give one row. ``rematch`` off leaves the profiles as the list has them.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    listed = [(r["alias"], r["company_std"]) for r in small_list(aliases.select("alias", "company_std"), most, "the list of names") if r["alias"] and r["company_std"]]
    profiles = Profiles([x for x in listed if x[1] != unknown])
    stand_ins = {" ".join(words(a)) for a, s in listed if s == unknown}
    letters = spark.createDataFrame([(x,) for x in sorted({x for pair in listed for x in pair})] or [("",)], "n string")

    # Pickled once for all the functions below, and fetched once per worker.
    shared = spark.sparkContext.broadcast(profiles)

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for n in b["n"]:
                state, found, w = ("none", [], []) if " ".join(words(n)) in stand_ins else known.match(n, exact=True)
                w = [MARK + x] if state == "none" and w and (x := as_initials(n)) else w
                rows.append((n, state, found, w, [MARK + x] if state == "one" and (x := initials_of(n, known.standard[found[0]])) else []))
            yield pd.DataFrame(rows, columns=["n", "state", "found", "words", "own"])

    def glued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            found = [known.glued(w[0]) for w in b["words"]]
            yield pd.DataFrame({"n": b["n"], "state": ["none" if not f else "one" if len(f) == 1 else "open" for f in found], "found": found, "words": b["words"], "own": [[] for _ in found]})

    def keyed(column: str, with_company: bool):  # noqa: ANN202
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys = lambda w: {w} if w[:1] == MARK else {k for x in (w, bared(w)) for f in forms(x) for k in deletions(f, allowed(f))}
                rows = [(k, *r) for r in b.itertuples(index=False) for k in keys(r[0])]
                yield pd.DataFrame(rows, columns=["k", column, "company_std"] if with_company else ["k", column]).drop_duplicates()

        return keys

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, v, s in zip(b["w"], b["v"], b["company_std"]):
                if w[:1] == MARK:
                    rows.append((w, s, 0.0, 1.0))
                    continue
                best = max((1 - d / max(len(x), len(y)) if (d := distance(x, y, most)) <= most else -1.0, -d) for a in {w, bared(w)} for x in forms(a) for y in forms(v) for most in (min(allowed(x), allowed(y)),))
                rows.append((w, s, float(-best[1]), best[0]))
            out = pd.DataFrame(rows, columns=["w", "company_std", "d", "sim"])
            yield out[out["sim"] >= 0]

    def deciding(least: float):  # noqa: ANN202
        def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for b in batches:
                rows = []
                for n, ws, near in zip(b["n"], b["words"], b["near"]):
                    hits = {x["w"]: [(c["company_std"], c["sim"]) for c in x["to"]] for x in near}
                    state, found = known.decide(list(ws), hits, least)
                    own = [x for x in ws if x in hits and len(x) >= 5 and not set(found).isdisjoint(c for c, _ in hits[x])] + ([MARK + i] if (i := initials_of(n, known.standard[found[0]])) else []) if state == "one" else []
                    rows.append((n, state, found, ws, own))
                yield pd.DataFrame(rows, columns=["n", "state", "found", "words", "own"])

        return decided

    shape = "n string, state string, found array<string>, words array<string>, own array<string>"
    names = df.select(F.col(name).alias("n")).where(F.length(F.trim("n")) > 0).distinct().join(bounded_broadcast(letters), "n", "left_anti")
    # Names are few bytes and much work: dealt out in turn, or AQE would leave them to a task or two.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    done = cut_table(names.repartition(parts).mapInPandas(first_round, shape), "names")
    results = [done.where("state <> 'none'").select("n", "state", "found")]
    left = done.where("state = 'none' and size(words) > 0").select("n", "words")
    taught = lambda made: made.where("state = 'one'").select(F.explode("own").alias("v"), F.col("found")[0].alias("company_std")).distinct()
    spellings, least = spark.createDataFrame(profiles.spellings() or [("", "")], "v string, company_std string").unionByName(taught(done)), 0.0
    settled = None
    one_word = (F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 9)
    while rematch:
        # Only spellings that the last round added enter blocking again; of a word's spellings the nearest count.
        spelled = spellings.repartition(parts).mapInPandas(keyed("v", True), "k string, v string, company_std string")
        asked = left.select(F.explode("words").alias("w")).distinct()
        # A word that stood near some spelling has its nearest; what others were taught later says nothing of it.
        asked = (asked if settled is None else asked.join(settled, "w", "left_anti")).repartition(parts).mapInPandas(keyed("w", False), "k string, w string")
        pairs = asked.join(spelled, "k").select("w", "v", "company_std").distinct().mapInPandas(verified, "w string, company_std string, d double, sim double")
        near = pairs.groupBy("w", "company_std").agg(F.min("d").alias("d"), F.max("sim").alias("sim")).groupBy("w").agg(F.min("d").alias("best"), F.collect_list(F.struct("company_std", "d", "sim")).alias("to"))
        near = cut_table(near.select("w", F.filter("to", lambda x: x["d"] == F.col("best")).alias("to")), "near")
        settled = near.select("w") if settled is None else settled.unionByName(near.select("w"))
        offers = left.select("n", "words", F.explode(F.array_distinct("words")).alias("w")).join(near, "w").groupBy("n", "words").agg(F.collect_list(F.struct("w", "to")).alias("near"))
        made = offers.mapInPandas(deciding(least), shape)
        if least == 0:
            # Names run together are compared whole with the list's; the profile's other words say nothing of them.
            runs = cut_table(left.where(one_word).repartition(parts).mapInPandas(glued, shape).where("state <> 'none'"), "runs")
            made = runs.unionByName(made.join(runs.select("n"), "n", "left_anti"))
        made = cut_table(made.where("state <> 'none'"), "merged")
        if made.isEmpty():
            break
        results.append(made.select("n", "state", "found"))
        spellings = taught(made)
        left = cut_table(left.join(made.select("n"), "n", "left_anti"), "left")
        # A spelling that only a merge has taught must be backed by the line of business.
        least = 0.5
    resolved = cut_table(reduce(DataFrame.unionByName, results), "resolved")
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("n"), (F.col(text) if text else F.lit(None).cast("string")).alias("t"))
    out = rows.select("k", "n").join(resolved.where("state = 'one'").select("n", F.col("found")[0].alias("company_std")), "n").select("k", "company_std")
    if text:

        def mentioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            starts = {s: forms(w[0]) | {w[0]} for s, w in known.standard.items()}
            for b in batches:
                picked = []
                for found, t in zip(b["found"], b["t"]):
                    seen = {f for x in words(t or "") for f in (x, fold(x))} if isinstance(t, str) else set()
                    run = " ".join(words(t)) if isinstance(t, str) else ""
                    full = [s for s in found if " ".join(known.standard[s]) in run]
                    fit = full or [s for s in found if seen & starts[s]]
                    picked.append(fit[0] if len(fit) == 1 else None)
                yield pd.DataFrame({"k": b["k"], "company_std": picked}).dropna()

        doubtful = rows.join(resolved.where("state = 'open'").select("n", "found"), "n").select("k", "found", "t")
        out = out.unionByName(doubtful.mapInPandas(mentioned, f"k {kind}, company_std string"))
    return out.distinct().withColumnRenamed("k", key)
