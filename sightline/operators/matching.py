"""Exact groups, blocked fuzzy candidates and mutual-best merging."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.similarity import jaccard, jaro_winkler
from sightline.session import cut_table

#: Rows of a block that meet at once (a larger block is cut into chunks that all meet each other), and pairs a task lists.
CHUNK_ROWS, TASK_PAIRS, MOST_TASKS = 4096, 4_000_000, 10_000
#: Rows of a chunk where every pair looks up the partners of its first side.
VETO_ROWS = 512


def exact_groups(df: DataFrame, key: list[str], publisher: list[str], order: list[Column]) -> DataFrame:
    """Rank pairing: the n-th copy of one publisher meets the n-th of another, never its own."""
    rank = F.dense_rank().over(W.partitionBy(*key, *publisher).orderBy(*order))
    return df.withColumn("pair_rank", rank).withColumn("match_group", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.col("pair_rank").cast("string"))))


def blocked_pairs(df: DataFrame, key: str, block: list[str], carry: list[str]) -> DataFrame:
    """Pairs a < b within a block, as <column>_a and <column>_b; equi join, so skew is AQE's to split."""
    side = lambda s: df.select(*[F.col(c).alias(f"_{c}") if s == "b" else F.col(c) for c in block], F.col(key).alias(f"{key}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carry])
    on = [F.col(c) == F.col(f"_{c}") for c in block] + [F.col(f"{key}_a") < F.col(f"{key}_b")]
    return side("a").join(side("b"), on).drop(*[f"_{c}" for c in block])


def _chunked(df: DataFrame, key: str, block: list[str], chunk_rows: int) -> tuple[DataFrame, int]:
    """Rows that can pair, with their chunk of the block and how many it has; the tasks that all pairs need.

    A small table can have many pairs, so tasks follow the pairs (of the counted blocks), not the bytes.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [key, *block]))
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = sizes.agg(F.sum(F.col("_rows").cast("double") * F.col("_rows") / 2)).first()[0] or 0.0
    tasks = min(max(ceil(pairs / TASK_PAIRS), df.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    rows = rows.join(sizes.select(*block, F.ceil(F.col("_rows") / chunk_rows).alias("_chunks")), block)
    return rows.withColumn("_chunk", F.pmod(F.xxhash64(key), F.col("_chunks"))), tasks


def _to_chunks(rows: DataFrame) -> DataFrame:
    """The rows once for each chunk of their block (_with)."""
    return rows.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks", "_chunk")


def _meet(a: DataFrame, b: DataFrame, block: list[str], tasks: int) -> DataFrame:
    """Rows of ``a`` with those of ``b`` in the chunk of the block that they are for; AQE keeps a stated number of partitions."""
    a = a.repartition(tasks, *block, "_with")
    b = b.select(*[F.col(c).alias(f"_{c}") for c in block], F.col("_chunk").alias("_own"), *[c for c in b.columns if c not in {*block, "_chunk"}]).repartition(tasks, *[f"_{c}" for c in block], "_own")
    on = [F.col(c) == F.col(f"_{c}") for c in block] + [F.col("_with") == F.col("_own")]
    return a.join(b, on).drop(*block, *[f"_{c}" for c in block], "_with", "_own")


def blocked_texts(df: DataFrame, key: str, block: list[str], text: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pairs of a block's texts, <text>_a and <text>_b, with the keys that have them, <key>s_a and <key>s_b.

    Texts that many rows share are compared once, not for every pair of rows; :func:`pair_keys` lists the rows' pairs.
    """
    rows, tasks = _chunked(df.select(key, *block, text), key, block, chunk_rows)
    texts = rows.groupBy(*block, "_chunks", "_chunk", text).agg(F.collect_list(key).alias("_keys"))
    side = lambda s: [*block, "_chunk", F.col(text).alias(f"{text}_{s}"), F.col("_keys").alias(f"{key}s_{s}")]
    return _meet(_to_chunks(texts.select(*side("a"), "_chunks")), texts.select(*side("b")), block, tasks)


def pair_keys(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs a < b of the keys that :func:`blocked_texts` gathered, as <key>_a and <key>_b, with the pairs' other columns."""
    a = pairs.select(*[c for c in pairs.columns if c != f"{key}s_a"], F.explode(f"{key}s_a").alias(f"{key}_a"))
    b = a.select(*[c for c in a.columns if c != f"{key}s_b"], F.explode(f"{key}s_b").alias(f"{key}_b"))
    return b.where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def score_pairs(pairs: DataFrame, text: str, floor: float = 50.0, with_jaro_winkler: bool = False) -> DataFrame:
    """Token Jaccard (and Jaro-Winkler) of the pairs' texts; pairs below the floor in both go."""
    out = pairs.withColumn("jaccard", jaccard(F.col(f"{text}_a"), F.col(f"{text}_b")))
    if not with_jaro_winkler:
        return out.where(F.col("jaccard") >= floor)
    out = out.withColumn("jaro_winkler", F.round(100 * jaro_winkler(F.col(f"{text}_a"), F.col(f"{text}_b")), 2))
    return out.where((F.col("jaccard") >= floor) | (F.col("jaro_winkler") >= floor))


def veto_shared(pairs: DataFrame, key: str, members: DataFrame, member: str, attribute: str) -> DataFrame:
    """Pairs of which no attribute value (a publisher) belongs to both sides."""
    x = members.select(F.col(member).alias("_m"), F.col(attribute).alias("_v")).distinct()
    shared = pairs.select(f"{key}_a", f"{key}_b").join(x.withColumnRenamed("_m", "_ma"), F.col(f"{key}_a") == F.col("_ma")).join(x.select(F.col("_m").alias("_mb"), F.col("_v").alias("_vb")), (F.col(f"{key}_b") == F.col("_mb")) & F.col("_v").eqNullSafe(F.col("_vb")))
    return pairs.join(shared.select(f"{key}_a", f"{key}_b").distinct(), [f"{key}_a", f"{key}_b"], "left_anti")


def unshared_pairs(df: DataFrame, key: str, block: list[str], members: DataFrame, member: str, attribute: str, chunk_rows: int = VETO_ROWS) -> DataFrame:
    """Pairs a < b within a block, as <key>_a and <key>_b, of which no attribute value belongs to both sides; nulls are no value.

    Only pairs that share a value are gathered, as lists of at most a chunk beside their first side; the others are never
    shuffled. Sharing doesn't depend on the block, so blocks of equal hashes add work and change nothing.
    """
    rows, tasks = _chunked(df.select(key, *block), key, block, chunk_rows)
    rows = rows.withColumn("_hash", F.xxhash64(*block))
    held = members.where(F.col(member).isNotNull() & F.col(attribute).isNotNull()).select(F.col(member).alias("_m"), F.col(attribute).alias("_v"))
    held = held.join(rows.select("_hash", "_chunk", F.col(key).alias("_k")), F.col("_m") == F.col("_k")).select("_hash", "_v", "_k", "_chunk").repartition("_hash", "_v").distinct()
    other = held.select(F.col("_hash").alias("_h"), F.col("_v").alias("_w"), F.col("_k").alias("_other"), F.col("_chunk").alias("_with"))
    shared = held.join(other, (F.col("_hash") == F.col("_h")) & (F.col("_v") == F.col("_w")) & (F.col("_k") < F.col("_other")))
    shared = shared.groupBy("_hash", F.col("_k").alias(key), "_with").agg(F.collect_set("_other").alias("_shared"))
    a = _to_chunks(rows).join(shared, ["_hash", key, "_with"], "left").select(*block, "_with", F.col(key).alias(f"{key}_a"), "_shared")
    pairs = _meet(a, rows.select(*block, "_chunk", F.col(key).alias(f"{key}_b")), block, tasks)
    free = F.col("_shared").isNull() | ~F.array_contains("_shared", F.col(f"{key}_b"))
    return pairs.where((F.col(f"{key}_a") < F.col(f"{key}_b")) & free).drop("_shared")


def mutual_best(pairs: DataFrame, key: str, score: str, threshold: float | None, gap: str | None = None) -> DataFrame:
    """Pairs in which each is the other's best; no chains. A null threshold switches the tier off.

    Best by score, then by the smaller ``gap``, then by the partner's key. Both directions are aggregated map-side with
    min_by, so a hub with many partners is no single task's.
    """
    kept = pairs.where(F.lit(False)) if threshold is None else pairs.where(F.col(score) >= threshold)
    apart = F.lit(0) if gap is None else F.coalesce(F.col(gap), F.lit(1 << 30))
    side = lambda x, y: F.struct(F.col(f"{key}_{x}").alias("x"), F.col(f"{key}_{y}").alias("y"), F.col(score).alias("s"), apart.alias("g"))
    return _mutual(kept.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).select("e.*"), key, score)


def _mutual(sides: DataFrame, key: str, score: str) -> DataFrame:
    """Of the partners y that each x has, by score s and gap g, the pairs in which each is the other's best."""
    best = sides.groupBy("x").agg(F.min(F.struct((-F.col("s")).alias("n"), "g", "y")).alias("b")).select("x", F.col("b.y").alias("y"), (-F.col("b.n")).alias(score))
    back = best.select(F.col("x").alias("_y"), F.col("y").alias("_x"))
    return best.join(back, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).where("x < y").select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"), score)


def _first_two(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of each group the rows of the first two values in this order; each task keeps its own two before they are shuffled."""
    return df.withColumn("_n", F.dense_rank().over(W.partitionBy(*by).orderBy(*order))).where("_n <= 2").drop("_n")


def mutual_best_texts(df: DataFrame, key: str, block: list[str], text: str, threshold: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """:func:`mutual_best` of a block's rows by the Jaccard of their texts, without a list of the rows' pairs.

    A row's best partner has one of the two smallest keys of its text, and is one of the two best that the row's own text
    has: the second counts where the first is the row itself. So the work follows the pairs of texts and the rows.
    """
    rows = df.where(F.col(key).isNotNull()).select(*block, text, key)
    heads = cut_table(_first_two(rows, [*block, text], [F.asc(key)]).groupBy(*block, text).agg(F.collect_set(key).alias("_keys")), "heads")
    texts, tasks = _chunked(heads, text, block, chunk_rows)
    side = lambda s: [*block, "_chunk", F.col(text).alias(f"{text}_{s}"), F.col("_keys").alias(f"{key}s_{s}")]
    met = _meet(_to_chunks(texts.select(*side("a"), "_chunks", F.struct(*block).alias("_block"))), texts.select(*side("b")), block, tasks)
    near = score_pairs(met.where(F.col(f"{text}_a") <= F.col(f"{text}_b")), text, threshold).coalesce(tasks)  # Spark may have joined in more partitions
    of = lambda x, y: F.struct(F.col(f"{text}_{x}").alias("_text"), F.col(f"{key}s_{y}").alias("_keys"))
    near = near.select("_block", "jaccard", F.explode(F.array(of("a", "b"), of("b", "a"))).alias("e")).select("_block", "jaccard", "e._text", F.explode("e._keys").alias("y"))
    near = near.groupBy("_block", "_text", "y").agg(F.max("jaccard").alias("s"))
    near = _first_two(near, ["_block", "_text"], [F.desc("s"), F.asc("y")])
    sides = rows.join(near, (F.struct(*block) == F.col("_block")) & (F.col(text) == F.col("_text"))).where(F.col(key) != F.col("y"))
    return _mutual(sides.select(F.col(key).alias("x"), "y", "s", F.lit(0).alias("g")), key, "jaccard")


def threshold_grid(scored: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """Precision and recall per threshold; one pass, the grid is a literal array."""
    steps = scored.select(F.explode(F.array(*map(F.lit, grid))).alias("threshold"), score, truth)
    hit = F.col(score) >= F.col("threshold")
    out = steps.groupBy("threshold").agg(F.count_if(hit & F.col(truth)).alias("tp"), F.count_if(hit & ~F.col(truth)).alias("fp"), F.count_if(~hit & F.col(truth)).alias("fn"))
    return out.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4))
