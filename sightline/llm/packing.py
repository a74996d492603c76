"""Filling fixed-capacity containers with texts, measured in tokens.

Pattern packing: the histogram of lengths has at most as many bins as the capacity, so
it fits the driver whatever the corpus. Patterns of few lengths that fill a container are
enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down; the residual histogram is packed largest first. The plan (at
most a few thousand patterns) is then laid over the rows: a row's rank among the rows of
its length tells its container. No text is split unless it alone exceeds the capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def patterns(lengths: list[int], capacity: int, partners: int = 12) -> list[tuple[int, ...]]:
    """Fillings of a container: each starts with one or two lengths and is completed by the largest that fit."""
    up, out = sorted(lengths), set()
    pick = sorted({up[int(i)] for i in np.linspace(0, len(up) - 1, min(partners, len(up)))}) if up else []
    for a in up:
        for b in [None, *pick]:
            parts, room = [a], capacity - a
            if b is not None and b <= room:
                parts.append(b)
                room -= b
            while room > 0 and (i := bisect_right(up, room)) and len(parts) < 64:
                # The next is the largest that leaves nothing or room for another one.
                step = up[i - 1] if len(parts) >= 2 or i == 1 else up[max(0, bisect_right(up, (room + 1) // 2) - 1)]
                parts.append(step)
                room -= step
            out.add(tuple(sorted(parts, reverse=True)))
    return sorted(out, reverse=True)


def fit(histogram: dict[int, int], shapes: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Repeat counts by non-negative least squares, coordinate by coordinate on the sparse columns."""
    left = {k: float(v) for k, v in histogram.items()}
    columns = [list(zip(*np.unique(s, return_counts=True))) for s in shapes]
    columns = [[(int(k), int(c)) for k, c in col] for col in columns]
    norms = [sum(c * c for _, c in col) for col in columns]
    x = np.zeros(len(shapes))
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(left[k] * c for k, c in col) / norms[j])
            if step:
                x[j] += step
                moved += abs(step)
                for k, c in col:
                    left[k] -= step * c
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram of lengths 1 to capacity exactly."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    shapes = patterns(list(left), capacity)
    for shape, times in sorted(zip(shapes, fit(left, shapes)), key=lambda p: (capacity - sum(p[0]), -p[1])):
        need = {k: shape.count(k) for k in shape}
        n = min(int(times), *(left.get(k, 0) // c for k, c in need.items()))
        if n > 0:
            out.append((shape, n))
            for k, c in need.items():
                left[k] -= n * c
    left = {k: v for k, v in left.items() if v > 0}
    while left:
        up, parts, room, used = sorted(left), [], capacity, {}
        while (i := bisect_right(up, room)) > 0:
            k = next((up[j] for j in range(i - 1, -1, -1) if left[up[j]] > used.get(up[j], 0)), None)
            if k is None:
                break
            parts.append(k)
            used[k] = used.get(k, 0) + 1
            room -= k
        n = min(left[k] // c for k, c in used.items())
        out.append((tuple(parts), n))
        for k, c in used.items():
            left[k] -= n * c
        left = {k: v for k, v in left.items() if v > 0}
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int]]]:
    """Per length: ends of the rank ranges and what to add to a rank to get its container."""
    out: dict[int, tuple[list[int], list[int]]] = {}
    base = 0
    for shape, n in made:
        for k in shape:
            ends, shifts = out.setdefault(k, ([], []))
            begin = ends[-1] if ends else 0
            ends.append(begin + n)
            shifts.append(base - begin)
        base += n
    return out


def pack(sizes: DataFrame, key: str, size: str, containers: list[tuple[str, int]], buckets: int = 16) -> DataFrame:
    """(container_kind, container_id, key, part, tokens): every text laid into each kind of container.

    ``containers``: (kind, capacity). A text above the capacity fills containers of its own
    and its rest is packed like any item; all others have one part, 0. Texts of no tokens
    need no room: their container_id is null. Ties and repeated rows are items of their own.
    ``sizes`` is read twice and should be materialised. Ranks are taken per length and hash
    bucket, so that a frequent length is no single task's; only counts per kind, length and
    bucket (bounded by kinds x capacity x buckets) reach the driver.
    """
    kind = sizes.schema[key].dataType.simpleString()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).alias("cap")) for k, c in containers])
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = sizes.select(F.col(key).alias("k"), n.alias("n"), F.explode(kinds).alias("c")).select("k", "n", "c.kind", "c.cap")
    full = rows.where("n > cap").select("k", "kind", F.explode(F.sequence(F.lit(0), F.expr("cast(n div cap - 1 as int)"))).alias("part"), F.col("cap").alias("tokens"))
    full = full.select(F.col("kind").alias("container_kind"), F.concat(F.lit("x"), F.col("k").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container_id"), "k", "part", F.col("tokens").cast("int").alias("tokens"))
    rest = rows.select("k", "kind", F.when(F.col("n") > F.col("cap"), F.expr("n % cap")).otherwise(F.col("n")).cast("int").alias("tokens"), F.when(F.col("n") > F.col("cap"), F.expr("n div cap")).otherwise(0).cast("int").alias("part"))
    rest = rest.where("tokens > 0 or part = 0").withColumn("b", F.pmod(F.xxhash64("k", "part"), F.lit(buckets)).cast("int"))
    items = rest.where("tokens > 0")
    counted = items.groupBy("kind", "tokens", "b").count().collect()
    cells: dict[tuple[str, int], list[int]] = {}
    for r in counted:
        cells.setdefault((r["kind"], r["tokens"]), [0] * buckets)[r["b"]] = r["count"]
    offsets = {k: [0, *np.cumsum(v).tolist()] for k, v in cells.items()}
    places = {name: slots(plan({t: sum(v) for (kd, t), v in cells.items() if kd == name}, cap)) for name, cap in containers}

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ids = []
            for kd, t, b, r in zip(p["kind"], p["tokens"], p["b"], p["rank"]):
                rank = offsets[kd, int(t)][int(b)] + int(r) - 1
                ends, shifts = places[kd][int(t)]
                ids.append(f"p{rank + shifts[bisect_right(ends, rank)]}")
            yield pd.DataFrame({"container_kind": p["kind"], "container_id": ids, "k": p["k"], "part": p["part"], "tokens": p["tokens"]})

    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("kind", "tokens", "b").orderBy("k", "part")))
    laid = ranked.mapInPandas(lay, f"container_kind string, container_id string, k {kind}, part int, tokens int")
    none = rest.where("tokens = 0").select(F.col("kind").alias("container_kind"), F.lit(None).cast("string").alias("container_id"), "k", "part", "tokens")
    return laid.unionByName(full).unionByName(none).withColumnRenamed("k", key)
