"""Matching entities across sources without keys, by a label model over heuristic votes.

Listings are read into canonical partial attributes (work and focus, level, place,
employer, text). Rows that agree in work, level, place and employer form a class, so a hot
group is one class and never all its pairs; where the employer is veiled, text and date
stand for it. Classes that share a block are candidates; several matching
functions vote on each (match, no match, abstain). A generative model learns from the
counts of the vote patterns alone how accurate each function is and which of them are
correlated (those are modelled jointly), and gives every candidate a posterior. Accepted
class pairs are expanded to pairs of rows on different sources at the very end.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.names import Profiles, core
from sightline.llm.places import AROUND, PlaceReader, place_entries
from sightline.llm.spelling import fold, words
from sightline.llm.survivors import plain, token_text, usable
from sightline.llm.titles import TitleWords
from sightline.session import cut_table, small_list

# Words of names that stand in for an undisclosed employer.
VEILED = {"confidential", "private", "undisclosed", "anonymous", "leading", "reputed", "client", "employer", "disclosed", "hidden", "سري", "سرية"}
#: The matching functions, in the order of the votes.
FUNCTIONS = ("employer", "mention", "level", "place", "text", "date")
#: Those whose attributes define an opening: who hires, on which level, where.
DEFINING = (0, 2, 3)


class LabelModel:
    """Generative model of votes: P(votes | kind of pair, who voted) as a product of factors.

    A pair is a match, or a non-match of one of several kinds: each kind differs in the
    attribute of one ``defining`` function and agrees in those named before it, whatever the
    others say (without any, there is one kind). A factor is one function, or several whose votes stay correlated within a kind
    and are then modelled jointly. Abstaining says nothing. Fitted by expectation-maximisation
    on counted patterns, started from the majority vote; functions are taken to be better than
    chance beforehand, with the weight of ``belief`` votes. Without negative pairs the prior of
    a match stays below one by the same weight.
    """

    def __init__(self, defining: tuple[int, ...] = (), correlated: float = 0.3, rounds: int = 200, belief: float = 20.0, accuracy: float = 0.8) -> None:
        self.defining, self.correlated, self.rounds, self.belief, self.accuracy = defining, correlated, rounds, belief, accuracy
        self.factors: list[tuple[int, ...]] = []
        self.kinds = 1 + max(1, len(defining))
        self.priors = [0.5] + [0.5 / (self.kinds - 1)] * (self.kinds - 1)
        self.tables: dict[tuple[int, ...], tuple[float, ...]] = {}

    @property
    def prior(self) -> float:
        """Share of matches among the candidates."""
        return self.priors[0]

    def fit(self, counts: dict[tuple[int, ...], float]) -> LabelModel:
        if not counts:
            return self
        width = len(next(iter(counts)))
        self.factors = [(i,) for i in range(width)]
        post = self._run(counts, {v: self._start(v) for v in counts})
        joined = [{i} for i in range(width)]
        for i, j in combinations(range(width), 2):
            a, b = next(s for s in joined if i in s), next(s for s in joined if j in s)
            if a is not b and len(a) + len(b) <= 3 and self._correlation(counts, post, i, j) > self.correlated:
                a |= b
                joined.remove(b)
        self.factors = sorted(tuple(sorted(s)) for s in joined)
        self._run(counts, post)
        return self

    def _start(self, v: tuple[int, ...]) -> list[float]:
        """Kinds of a pattern by majority; one that differs in a defining attribute is hardly a match."""
        differs = [float(v[k] == -1 and -1 not in [v[j] for j in self.defining[:i]]) for i, k in enumerate(self.defining)] or [1.0]
        match = 1 / (1 + math.exp(-1.5 * sum(v)))
        match = min(match, 0.2) if self.defining and any(differs) else match
        differs = differs if any(differs) else [1.0] * len(differs)
        return [match, *((1 - match) * x / sum(differs) for x in differs)]

    def _believed(self, kind: int, function: int, vote: int) -> float:
        """Chance of a vote in a kind of pair, before any is seen."""
        right = self.accuracy if vote == 1 else 1 - self.accuracy
        if kind == 0:
            return right
        if function not in self.defining or self.defining[kind - 1] == function:
            return 1 - right
        return right if function in self.defining[: kind - 1] else 0.5

    def _run(self, counts: dict, post: dict) -> dict:
        total = sum(counts.values())
        for _ in range(self.rounds):
            shares = [max((sum(counts[v] * post[v][c] for v in counts) + self.belief / self.kinds) / (total + self.belief), 1e-4) for c in range(self.kinds)]
            self.priors = [x / sum(shares) for x in shares]
            seen: dict[tuple, list[float]] = {}
            for f in self.factors:
                for v, n in counts.items():
                    cell = seen.setdefault((f, tuple(v[i] for i in f)), [0.0] * self.kinds)
                    for c in range(self.kinds):
                        cell[c] += n * post[v][c]
            self.tables = {}
            for f in self.factors:
                for mask in {tuple(x != 0 for x in key) for g, key in seen if g == f}:
                    voted = sum(mask)
                    if not voted:
                        continue
                    cells = {}
                    for bits in range(2**voted):
                        signs = iter(1 if bits >> k & 1 else -1 for k in range(voted))
                        key = tuple(next(signs) if m else 0 for m in mask)
                        found = seen.get((f, key), [0.0] * self.kinds)
                        # A kind agrees in the attributes named before its own: that is what the kind means, so it isn't learned.
                        barred = [c > 1 and any(x == -1 and i in self.defining[: c - 1] for i, x in zip(f, key)) for c in range(self.kinds)]
                        cells[key] = [1e-3 if barred[c] else found[c] + self.belief * math.prod(self._believed(c, i, x) for i, x in zip(f, key) if x) for c in range(self.kinds)]
                    sums = [sum(cell[c] for cell in cells.values()) for c in range(self.kinds)]
                    self.tables |= {(f, key): tuple(cell[c] / sums[c] for c in range(self.kinds)) for key, cell in cells.items()}
            new = {v: self._kinds_of(v) for v in counts}
            moved = max(abs(new[v][0] - post[v][0]) for v in counts)
            post = new
            if moved < 1e-6:
                break
        return post

    def _kinds_of(self, votes: tuple[int, ...]) -> list[float]:
        logs = [math.log(x) for x in self.priors]
        for f in self.factors:
            for c, x in enumerate(self.tables.get((f, tuple(votes[i] for i in f)), (1.0,) * self.kinds)):
                logs[c] += math.log(x)
        top = max(logs)
        odds = [math.exp(max(x - top, -60.0)) for x in logs]
        return [x / sum(odds) for x in odds]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Confidence that a pair with these votes is a match."""
        return self._kinds_of(votes)[0]

    @staticmethod
    def _correlation(counts: dict, post: dict, i: int, j: int) -> float:
        """Greatest correlation of two functions' votes within a class, where both vote."""
        best = 0.0
        both = [v for v in counts if v[i] and v[j]]
        for weight in [lambda v, c=c: post[v][c] for c in range(len(next(iter(post.values()))))]:
            n = sum(counts[v] * weight(v) for v in both)
            if n < 10:
                continue
            mean = [sum(counts[v] * weight(v) * v[k] for v in both) / n for k in (i, j)]
            cov = sum(counts[v] * weight(v) * (v[i] - mean[0]) * (v[j] - mean[1]) for v in both) / n
            var = [sum(counts[v] * weight(v) * (v[k] - m) ** 2 for v in both) / n for k, m in zip((i, j), mean)]
            if min(var) > 1e-9:
                best = max(best, cov / math.sqrt(var[0] * var[1]))
        return best


class ListingReader:
    """Reads title, place and employer of single rows; all it holds comes from lists of bounded size."""

    def __init__(self, titles: TitleWords, places: PlaceReader, cities: set[str], companies: Profiles, stand_ins: set[str]) -> None:
        self.titles, self.places, self.cities, self.companies, self.stand_ins = titles, places, cities, companies, stand_ins
        self.known: dict[str, tuple[str | None, str | None]] = {}
        self.lines: dict[tuple[str, ...], str] = {}

    def employer(self, name: str | None) -> tuple[str | None, str | None]:
        """(distinctive word, line of business), both None where the employer is veiled or open."""
        if not isinstance(name, str) or not name.strip():
            return None, None
        if name not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[name] = self._employer(name)
        return self.known[name]

    def _employer(self, name: str) -> tuple[str | None, str | None]:
        if " ".join(words(name)) in self.stand_ins or set(words(name)) & VEILED:
            return None, None
        state, found, w = self.companies.match(name)
        if state == "one":
            return fold(self.companies.standard[found[0]][0]), " ".join(self.companies.business[found[0]])
        own = [x for x in w if not self.companies.is_trade(x)]
        if state == "open" or not own:
            return None, None
        plain = own[0][2:] if own[0].startswith("al") and len(own[0]) > 6 else own[0]
        return fold(plain), self._line([x for x in w if x not in own])

    def _line(self, rest: list[str]) -> str:
        key = tuple(rest)
        if key not in self.lines:
            best = sorted(((self.companies.agrees(rest, s), " ".join(self.companies.business[s])) for s in self.companies.standard), key=lambda x: (-x[0], x[1])) if rest else []
            self.lines[key] = best[0][1] if best and best[0][0] > 0 else " ".join(sorted(rest))
        return self.lines[key]

    def city(self, raw: str | None, stated: str | None) -> str | None:
        if isinstance(raw, str) and raw.strip() and (read := self.places.read(raw)) in self.cities:
            return read
        return stated if isinstance(stated, str) and stated in self.cities else None


def read_listings(listings: DataFrame, mapping: DataFrame, aliases: DataFrame, share: float = 0.001) -> DataFrame:
    """(k, source, work, level, city, first, line, t, said, named, posting_date) of listings.

    ``said`` are the folded words of the text of a listing whose employer is veiled, and
    ``named`` tells whether a listed name is among them.
    """
    fields = listings.select(F.col("source_record_sk").alias("k"), F.regexp_replace(F.lower(F.trim("source_name")), r"\.example$", "").alias("source"), F.coalesce("job_title", "title_norm").alias("title"), "location_raw", "city_std", "company_name", "posting_date", F.when(usable(F.col("description_text")), token_text(plain(F.col("description_text")))).alias("t")).where("k is not null")
    split = F.array_distinct(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+"))
    total = fields.count()
    # Words in at least a fixed share of all titles: at most (words per title / share) of them.
    common = fields.select(F.explode(split).alias("w")).where("w <> ''").groupBy("w").count().where(F.col("count") >= share * total).collect()
    cities, regions = place_entries(mapping)
    rows = small_list(mapping.select("alias", "city_std"), 20_000, "the list of places")
    place_words = {w for r in rows for x in (r["alias"], r["city_std"]) if x for w in words(x)} | {"al", "el"}
    listed = [(r["alias"], r["company_std"]) for r in small_list(aliases.select("alias", "company_std"), 100_000, "the list of names") if r["alias"] and r["company_std"]]
    reader = ListingReader(TitleWords({r["w"]: r["count"] for r in common}, place_words), PlaceReader(cities, regions, AROUND), {c for _, c in cities.rows}, Profiles([x for x in listed if x[1] != "Unknown"]), {" ".join(words(a)) for a, s in listed if s == "Unknown"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, source, title, raw, stated, name, day, t in zip(b["k"], b["source"], b["title"], b["location_raw"], b["city_std"], b["company_name"], b["posting_date"], b["t"]):
                work, level = reader.titles.read(title) if isinstance(title, str) else ([], [])
                first, line = reader.employer(name)
                heard = list(map(fold, t.split())) if first is None and isinstance(t, str) else None
                out.append((k, source, " ".join(work), " ".join(level), reader.city(raw, stated), first, line, t, heard and " ".join(heard), heard and any(len(x) > 4 and x in reader.companies.first for x in heard), day))
            yield pd.DataFrame(out, columns=["k", "source", "work", "level", "city", "first", "line", "t", "said", "named", "posting_date"])

    return fields.mapInPandas(read, "k string, source string, work string, level string, city string, first string, line string, t string, said string, named boolean, posting_date date")


def _votes() -> list[Column]:
    """Votes of the matching functions on a pair of classes: 1, -1 or 0."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    known = a("first").isNotNull() & b("first").isNotNull()
    one_line = (a("line") == b("line")) | (a("line") == "") | (b("line") == "")
    apart = F.levenshtein(a("first"), b("first"), 4)
    # Two typists may each err once: two edits apart are one name, up to four say nothing.
    employer = F.when(known & (apart >= 0) & (apart <= 2) & one_line, 1).when(known & (apart > 2) & one_line, 0).when(known, -1).otherwise(0)
    # A veiled employer whose text names the other one, or names someone else.
    said, named_any = F.coalesce(F.when(a("first").isNull(), a("said")), b("said")), F.coalesce(F.when(a("first").isNull(), a("named")), b("named"))
    other = F.coalesce(a("first"), b("first"))
    named = F.contains(F.concat(F.lit(" "), said, F.lit(" ")), F.concat(F.lit(" "), other, F.lit(" ")))
    mention = F.when(known, 0).when(named, 1).when(other.isNotNull() & named_any, -1).otherwise(0)
    level = F.when(a("level") == b("level"), 1).otherwise(-1)
    place = F.when(a("city").isNotNull() & b("city").isNotNull(), F.when(a("city") == b("city"), 1).otherwise(-1)).otherwise(0)
    # The middle of the shorter text, whose ends may be cut, stands in the longer one or not.
    short, long = F.when(F.length(a("t")) <= F.length(b("t")), a("t")).otherwise(b("t")), F.when(F.length(a("t")) <= F.length(b("t")), b("t")).otherwise(a("t"))
    middle = F.regexp_extract(short, r"^\S+ (.*) \S+$", 1)
    text = F.when(F.length(middle) >= 25, F.when(F.contains(long, middle), 1).otherwise(-1)).otherwise(0)
    gap = F.abs(F.datediff(a("day"), b("day")))
    date = F.when(gap <= 7, 1).when(gap > 14, -1).otherwise(0)
    return [F.coalesce(v, F.lit(0)).cast("int").alias(n) for n, v in zip(FUNCTIONS, (employer, mention, level, place, text, date))]


def link(listings: DataFrame, mapping: DataFrame, aliases: DataFrame, accept: float = 0.5) -> DataFrame:
    """(listing_a, listing_b, confidence): pairs of rows on different sources that are one opening.

    Rows that agree in work, level, place and employer are one class, without a known employer
    in text and date as well, so that all of them vote. Candidates are pairs of classes that
    share the work and the place, or the work and the employer; where one has no place, a known
    employer that the other's text may mention; for a class without place and employer a piece
    of text. A class is a candidate with itself, and merged only if its votes suffice. Null
    titles, places, names and texts abstain; repeated rows give one pair; an empty table gives
    none. All pairs of accepted classes are given.
    """
    rows = cut_table(read_listings(listings, mapping, aliases).where("work <> ''").dropDuplicates(["k"]), "read")
    rows = rows.withColumn("own", F.when(F.col("first").isNull(), F.struct("t", "posting_date")))
    keys = ["work", "level", "city", "first", "line", "own"]
    rows = rows.withColumn("c", F.xxhash64(*[F.coalesce(F.col(x), F.lit("\0")) for x in [*keys[:-1], "own.t"]], F.coalesce(F.col("own.posting_date").cast("string"), F.lit("\0"))))
    classes = rows.groupBy("c", *keys).agg(F.max_by("t", F.length(F.coalesce("t", F.lit("")))).alias("t"), F.max("said").alias("said"), F.max("named").alias("named"), F.min("posting_date").alias("day"), F.countDistinct("source").alias("sources"))
    classes = cut_table(classes.drop("own"), "classes")
    place = classes.where("city is not null").withColumn("block", F.xxhash64(F.lit("place"), "work", "city"))
    named = classes.where("first is not null").withColumn("block", F.xxhash64(F.lit("name"), "work", "first"))
    veiled = classes.where("first is null and t is not null")
    # Each word of a veiled employer's text may be another's name, as names are compared: folded.
    asking = veiled.withColumn("block", F.explode(F.array_distinct(F.transform(F.split("said", " "), lambda w: F.xxhash64(F.lit("name"), F.col("work"), w)))))
    middle = F.regexp_extract("t", r"^\S+ (.*) \S+$", 1)

    def candidates(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
        pairs = x.alias("a").join(y.alias("b"), (F.col("a.block") == F.col("b.block")) & more)
        return pairs.select(F.least("a.c", "b.c").alias("x"), F.greatest("a.c", "b.c").alias("y"), *_votes())

    once, other = F.col("a.c") < F.col("b.c"), F.col("a.c") != F.col("b.c")
    blocked = [(place, place, once), (named, named, once), (asking, named, F.col("a.city").isNull() | F.col("b.city").isNull())]
    bare = veiled.where("city is null")
    if not bare.isEmpty():
        # A shorter text's middle stands in a longer one only if its least piece does: that one is asked for among all.
        near = cut_table(classes.where("t is not null").join(bare.select("work").distinct(), "work", "left_semi"), "near")
        pieces = lambda t: F.expr(f"transform(sequence(1, greatest(size({t}) - 1, 1)), i -> xxhash64(work, get({t}, i - 1), get({t}, i)))")
        near = near.withColumn("_w", F.split("t", " ")).withColumn("_m", F.split(middle, " ")).withColumn("all", F.array_distinct(pieces("_w"))).withColumn("least", F.array_min(pieces("_m")))
        near = cut_table(near.drop("_w", "_m"), "pieces")
        each, one, is_bare = near.withColumn("block", F.explode("all")), near.withColumn("block", F.col("least")), "first is null and city is null"
        blocked += [(one.where(is_bare), each, other), (each.where(is_bare), one, other)]
    apart = reduce(DataFrame.unionByName, [candidates(*x) for x in blocked]).distinct()
    itself = classes.where("sources > 1 and (city is not null or first is not null or t is not null)").alias("a")
    # A class without a known employer is of one text and one date; those of others differ and say nothing.
    alike = lambda known: F.when(F.col("first").isNull() & known, 1).otherwise(0)
    alone = itself.select(F.col("c").alias("x"), F.col("c").alias("y"), F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("employer"), F.lit(0).alias("mention"), F.lit(1).alias("level"), F.when(F.col("city").isNotNull(), 1).otherwise(0).alias("place"), alike(F.length(F.coalesce(middle, F.lit(""))) >= 25).alias("text"), alike(F.col("day").isNotNull()).alias("date"))
    voted = cut_table(apart.withColumn("apart", F.lit(True)).unionByName(alone.withColumn("apart", F.lit(False))), "votes")
    # At most three to the number of functions patterns, whatever the corpus. Classes compared
    # with themselves teach nothing about the functions, they are only scored.
    counted = voted.groupBy(*FUNCTIONS).agg(F.count_if("apart").alias("n")).collect()
    patterns = {tuple(r[n] for n in FUNCTIONS): float(r["n"]) for r in counted}
    model = LabelModel(DEFINING).fit({v: n for v, n in patterns.items() if n})
    scored = [(*p, model.posterior(p)) for p in patterns]
    schema = ", ".join(f"{n} int" for n in FUNCTIONS) + ", confidence double"
    taken = voted.join(F.broadcast(listings.sparkSession.createDataFrame(scored, schema)), list(FUNCTIONS)).where(F.col("confidence") >= accept).select("x", "y", "confidence")
    left, right = rows.select(F.col("c").alias("x"), F.col("k").alias("p"), F.col("source").alias("s")), rows.select(F.col("c").alias("y"), F.col("k").alias("q"), F.col("source").alias("r"))
    pairs = taken.join(left, "x").join(right, "y").where("s <> r and (x <> y or p < q)")
    return pairs.groupBy(F.least("p", "q").alias("listing_a"), F.greatest("p", "q").alias("listing_b")).agg(F.max("confidence").alias("confidence"))
