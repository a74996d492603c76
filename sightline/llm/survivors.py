"""Best representative of each duplicate group, field by field.

What a group's texts say in full is found by token-level consensus: the distinct values
are aligned progressively, longest first, their tokens vote per column with the weight of
their source, and a value is full if it stands close to the consensus from its first to
its last token, however it ends itself. Choices are then single aggregates over ordered
structs, so a group of any size is combined before the shuffle and never gathered;
alignments run over batches of bounded size whose consensuses are aligned again.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.writing import plain_spaces, unescape
from sightline.operators.units import states_amount
from sightline.session import bounded_broadcast, cut_table

# Stand-ins that say nothing, lower case.
STAND_INS = ["", "-", "--", "—", "?", ".", "n/a", "n.a.", "n.a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "unknown", "unspecified", "undefined", "not specified", "not available", "not disclosed", "see description", "see website", "see job description", "description not available", "no description", "to be confirmed", "غير محدد", "غير معروف", "other"]
ELLIPSIS = r"\.\.\.|…|\[more\]|\[\.\.\.\]|read more"
#: Texts aligned in one batch.
BATCH = 32


def usable(value: Column) -> Column:
    """Neither null nor blank nor a stand-in."""
    return F.coalesce(~F.lower(plain_spaces(value)).isin(STAND_INS), F.lit(False))


def plain(text: Column) -> Column:
    """Text without markup, entities and odd spaces."""
    return plain_spaces(F.regexp_replace(unescape(text), r"<[^<>]{0,200}>", " "))


def whole_ending(text: Column) -> Column:
    """Starts and ends as a text does: no mark of a cut, and a sentence brought to its end."""
    return ~text.rlike(rf"(?i)^\s*(?:{ELLIPSIS})|(?:{ELLIPSIS})\s*$") & text.rlike(r"[.!?؟)»\"”']\s*$")


def token_text(text: Column) -> Column:
    """Lower-case tokens joined by blanks, marks of cuts removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"(?i)^\s*(?:{ELLIPSIS})|(?:{ELLIPSIS})\s*$", " "), r"[^\p{L}\p{N}]+", " "))


def excerpt_at(tokens: list[str], whole: list[str], joined: str) -> int | None:
    """Where a text stands as a run in a longer one; its first and last word may be cut."""
    inner = tokens[1:-1]
    if not inner:
        return next((i for i in range(len(whole) - len(tokens) + 1) if whole[i : i + len(tokens)] == tokens), None)
    at = f" {joined} ".find(f" {' '.join(inner)} ")
    start = f" {joined} "[:at].count(" ") - 1
    if at < 0 or start < 0 or start + len(tokens) > len(whole):
        return None
    return start if whole[start].endswith(tokens[0]) and whole[start + len(tokens) - 1].startswith(tokens[-1]) else None


def consensus(texts: list[tuple[str, float]]) -> tuple[str, float]:
    """Token consensus of weighted token texts by progressive alignment, longest first.

    Columns are opened by the first text that has them; each further text is aligned to the
    current consensus, votes for the tokens of its columns and adds columns of its own. A
    column stays if it carries a vote from a text that reaches it; ties keep the earlier token.
    """
    order = sorted(texts, key=lambda x: (-len(x[0]), x[0]))
    columns: list[dict[str, float]] = [{t: order[0][1]} for t in order[0][0].split()]
    joined = " ".join(max(c, key=c.get) for c in columns)
    total = order[0][1]
    for text, weight in order[1:]:
        total += weight
        tokens = text.split()
        if not tokens:
            continue
        current = joined.split()
        if (start := excerpt_at(tokens, current, joined)) is not None:
            for i, t in enumerate(tokens, start):
                if current[i] == t:
                    columns[i][t] += weight
            continue
        matcher = SequenceMatcher(None, current, tokens, autojunk=False)
        fresh: list[dict[str, float]] = []
        for tag, i1, i2, j1, j2 in matcher.get_opcodes():
            for i, j in zip(range(i1, i2), range(j1, j2)):
                columns[i][tokens[j]] = columns[i].get(tokens[j], 0.0) + weight
            fresh += columns[i1:i2]
            if tag in ("insert", "replace"):
                fresh += [{tokens[j]: weight} for j in range(j1 + (i2 - i1), j2)]
        columns = fresh
        joined = " ".join(max(c, key=c.get) for c in columns)
    return " ".join(max(c, key=c.get) for c in columns), total


def group_consensus(texts: DataFrame) -> DataFrame:
    """(g, consensus) from (g, t, w): distinct token texts of each group with their weights.

    Groups are split into batches of about :data:`BATCH` texts by hash; the batches'
    consensuses are texts of the next pass, until each group has one.
    """

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [consensus([(x["t"], x["w"]) for x in xs]) if len(xs) > 1 else (xs[0]["t"], xs[0]["w"]) for xs in b["xs"]]
            yield pd.DataFrame({"g": b["g"], "b": b["b"], "t": [x[0] for x in done], "w": [x[1] for x in done]})

    kind = texts.schema["g"].dataType.simpleString()
    while True:
        parts = texts.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("n"))
        split = parts.where("n > 1")
        batched = texts.join(split, "g", "left").select("g", "t", "w", F.coalesce(F.pmod(F.xxhash64("t"), F.col("n")).cast("int"), F.lit(0)).alias("b"))
        made = cut_table(batched.groupBy("g", "b").agg(F.collect_list(F.struct("t", "w")).alias("xs")).mapInPandas(align, f"g {kind}, b int, t string, w double"), "consensus")
        if made.where("b > 0").isEmpty():
            return made.select("g", F.col("t").alias("consensus"))
        texts = made.groupBy("g", "t").agg(F.sum("w").alias("w"))


def survivors(listings: DataFrame, groups: DataFrame, sources: DataFrame, closeness: float = 0.9) -> DataFrame:
    """(job_sk, field_name, source_record_sk): the listing whose value survives, field by field.

    Which description is full the consensus of the group's texts decides; ``closeness`` is the
    share of tokens that a full text has in common with it (0 leaves the consensus out). The
    other fields are single values, of which trust and recency choose.

    A usable value goes before none, for the description a whole text before an excerpt, then
    the source more trusted in ``sources`` (unknown sources last), then the later
    ``last_seen_at``, then the greater key. 'record' uses trust and recency alone. Groups of
    fewer than two distinct listings, and fields without a usable value, give no row.
    Repeated rows change nothing; null keys are no listings.
    """
    trust = sources.select(F.lower(F.trim("source_name")).alias("_s"), F.col("source_priority").cast("int").alias("_p")).groupBy("_s").agg(F.min("_p").alias("_p"))
    fields = listings.select("source_record_sk", F.regexp_replace(F.lower(F.trim("source_name")), r"\.example$", "").alias("_s"), "description_text", "salary_text", "employment_type", "posting_date", "last_seen_at")
    pairs = groups.select("job_sk", "source_record_sk").where("job_sk is not null and source_record_sk is not null").distinct()
    rows = pairs.join(fields, "source_record_sk").join(bounded_broadcast(trust), "_s", "left")
    text = plain(F.col("description_text"))
    rows = rows.select("job_sk", F.col("source_record_sk").alias("k"), F.coalesce("_p", F.lit(1 << 30)).alias("p"), "last_seen_at", text.alias("d"), usable(F.col("description_text")).alias("u_d"), (usable(F.col("salary_text")) & states_amount(F.col("salary_text"))).alias("u_s"), usable(F.col("employment_type")).alias("u_e"), F.col("posting_date").isNotNull().alias("u_p"))
    rows = cut_table(rows.withColumn("ends", F.col("u_d") & whole_ending(F.col("d"))).withColumn("t", F.when(F.col("u_d"), token_text(F.col("d")))).drop("d"), "fields")
    texts = rows.where("u_d").groupBy(F.col("job_sk").alias("g"), "t").agg(F.sum(1.0 / F.greatest(F.col("p"), F.lit(1))).alias("w"))
    agreed = group_consensus(texts)
    # A text is full if it stands close to the consensus and reaches from its first to its last token;
    # the consensus is a full text's if one of those that reach its end ends as a text does.
    tokens = lambda c: F.split(c, " ")
    same_end = lambda at: F.element_at(tokens(F.col("t")), at) == F.element_at(tokens(F.col("consensus")), at)
    overlap = F.size(F.array_intersect(tokens(F.col("t")), tokens(F.col("consensus")))) >= closeness * F.size(F.array_union(tokens(F.col("t")), tokens(F.col("consensus"))))
    compared = rows.where("u_d").groupBy("job_sk", "t").agg(F.bool_or("ends").alias("ends")).join(agreed.withColumnRenamed("g", "job_sk"), "job_sk")
    near = compared.where(overlap & same_end(1) & same_end(-1) if closeness > 0 else F.lit(True))
    complete = near.groupBy("job_sk").agg(F.bool_or("ends").alias("complete")).where("complete").select("job_sk")
    near = near.join(complete, "job_sk", "left_semi").select("job_sk", "t", F.lit(True).alias("full"))
    judged = rows.join(near, ["job_sk", "t"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    key = [(-F.col("p")).alias("p"), F.col("last_seen_at").alias("at"), F.col("k").alias("k")]
    best = lambda name, flag, *first: F.max(F.when(flag, F.struct(*first, *key)))["k"].alias(name)
    chosen = judged.groupBy("job_sk").agg(
        F.countDistinct("k").alias("n"), best("record", F.lit(True)), best("description_text", F.col("u_d"), F.col("full")),
        best("salary_text", F.col("u_s")), best("employment_type", F.col("u_e")), best("posting_date", F.col("u_p")),
    )
    names = ["record", "description_text", "salary_text", "employment_type", "posting_date"]
    laid = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("source_record_sk")) for n in names])
    return chosen.where("n >= 2").select("job_sk", F.inline(laid)).where("source_record_sk is not null")
