"""What changed between full snapshots: set reconciliation by invertible Bloom lookup tables.

Every row of a snapshot becomes an element (key hash, content hash). For each pair of
successive snapshots of a collection the elements of the newer one are added to, those
of the older one subtracted from an invertible Bloom lookup table, split over buckets of
the key hash so that no table belongs to one task. Rows are shuffled once, by collection
and part of the key hash; both sides of a key then meet in one task, where what both
snapshots hold cancels, and no cell travels. A table is peeled to the differing elements
and verified against an independent digest of its bucket. Buckets that cannot be peeled
get larger tables, round by round; what is left after the last round is compared
directly. Recovered key hashes are resolved to keys by a join.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sightline.functions.writing import content_only
from sightline.session import bounded_broadcast, cut_table

_MASK = (1 << 64) - 1
_SLICE = (1 << 21) - 1
#: Seeds of the check, position and digest hashes; each is the first column of an xxhash64.
CHECK, PLACE, DIGEST = 1, 2, 3


def chained(seed: int, *values: int) -> int:
    """Spark's xxhash64 of long columns: standard XXH64 of eight bytes, seeded by the hash before."""
    h = 42
    for v in (seed, *values):
        h = xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def peel(cells: list[tuple[int, int, int, int, int]], third: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Differing elements (sign, key hash, content hash) of a table and whether it was emptied.

    ``cells``: (cell, count, xor of key hashes, of content hashes, of checks); positions below
    0 are ignored. A cell is pure if its count is one either way and its check is that of
    its element.
    """
    at = {c: [n, k, v, x] for c, n, k, v, x in cells if c >= 0}
    stack, found = [c for c, w in at.items() if w[0] in (1, -1)], []
    while stack:
        w = at.get(stack.pop())
        if w is None or w[0] not in (1, -1):
            continue
        sign, k, v, x = w
        if _signed(chained(CHECK, k, v)) != x:
            continue
        found.append((sign, k, v))
        place = chained(PLACE, k, v)
        for i in range(3):
            c = i * third + ((place >> (21 * i)) & _SLICE) % third
            u = at.setdefault(c, [0, 0, 0, 0])
            u[0] -= sign
            u[1] ^= k
            u[2] ^= v
            u[3] ^= x
            if u[0] in (1, -1):
                stack.append(c)
    return found, not any(any(w) for w in at.values())


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for pair, part, bucket, third, cells in zip(b["pair"], b["part"], b["bucket"], b["third"], b["cells"]):
            table = [(c["cell"], c["n"], c["k"], c["v"], c["x"]) for c in cells]
            digest = next((c[4] for c in table if c[0] == -1), 0)
            found, done = peel(table, int(third))
            for _, k, v in found:
                digest ^= _signed(chained(DIGEST, k, v))
            ok = bool(done and digest == 0)
            rows.append((pair, part, bucket, ok, [{"sign": s, "k": k, "v": v} for s, k, v in found] if ok else []))
        yield pd.DataFrame(rows, columns=["pair", "part", "bucket", "ok", "found"])


def _tables(elements: DataFrame, by: list[str], third: int) -> DataFrame:
    """Cells of the subtracted tables, those that cancelled left out, one row per bucket.

    ``by`` are the columns by which the elements are spread: where both sides of a key are in
    one task already, subtraction is local and nothing is shuffled again.
    """
    size = F.lit(third)
    place = F.xxhash64(F.lit(PLACE).cast("long"), "k", "v")
    slot = lambda i: (F.lit(i) * size + F.pmod(F.shiftrightunsigned(F.col("place"), 21 * i).bitwiseAND(F.lit(_SLICE)), size)).cast("int")
    cell = lambda c, n, k, v, x: F.struct(c.cast("int").alias("cell"), n.cast("int").alias("n"), k.alias("k"), v.alias("v"), x.alias("x"))
    zero, check = F.lit(0).cast("long"), F.xxhash64(F.lit(CHECK).cast("long"), "k", "v")
    parts = [cell(slot(i), F.col("sign"), F.col("k"), F.col("v"), F.col("check")) for i in range(3)] + [cell(F.lit(-1), F.lit(0), zero, zero, F.xxhash64(F.lit(DIGEST).cast("long"), "k", "v"))]
    group = list(dict.fromkeys([*by, "pair", "part", "bucket"]))
    laid = elements.withColumn("place", place).withColumn("check", check).select(*group, F.explode(F.array(*parts)).alias("c"))
    summed = laid.groupBy(*group, F.col("c.cell").alias("cell")).agg(F.sum("c.n").cast("int").alias("n"), *[F.bit_xor(f"c.{x}").alias(x) for x in ("k", "v", "x")])
    left = summed.where("n <> 0 or k <> 0 or v <> 0 or x <> 0")
    return left.groupBy(*group).agg(F.collect_list(F.struct("cell", "n", "k", "v", "x")).alias("cells")).select("pair", "part", "bucket", size.alias("third"), "cells")


def _direct(elements: DataFrame) -> DataFrame:
    """The exact difference of the buckets that no table could carry."""
    net = elements.groupBy("pair", "part", "bucket", "k", "v").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return net.select("pair", F.col("sign").cast("int").alias("sign"), "k", "v")


def differences(elements: Callable[[DataFrame | None], DataFrame], by: list[str], per_bucket_cells: int = 96, grow: int = 4, rounds: int = 3) -> DataFrame:
    """(pair, sign, k, v) of all elements that are not in both snapshots of a pair.

    ``elements`` gives pair, part, bucket, sign (+1 newer, -1 older), k, v, each element at most
    once per side: all of them, or those of the (pair, part, bucket) it is given. Tables start
    with ``per_bucket_cells`` cells and grow by ``grow`` each round; after ``rounds`` rounds the
    rest is compared directly, so nothing is lost.
    """
    schema = "pair long, part int, bucket int, ok boolean, found array<struct<sign:int,k:long,v:long>>"
    out, failed, third = [], None, per_bucket_cells // 3
    for _ in range(rounds):
        decoded = cut_table(_tables(elements(failed), by, third).mapInPandas(_decode, schema), "iblt")
        out.append(decoded.where("ok").select("pair", F.inline("found")))
        failed = decoded.where(~F.col("ok")).select("pair", "part", "bucket")
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, out)
        third *= grow
    return reduce(DataFrame.unionByName, [*out, _direct(elements(failed))])


def snapshot_changes(rows: DataFrame, calendar: DataFrame, collection: list[str], key: str, content: list[str], day: str, latest: str, calendar_day: str, successful: str, per_bucket: int = 64, per_part: int = 100_000) -> DataFrame:
    """Records added, removed or changed between consecutive successful snapshots.

    ``calendar`` lists the tries: a day with a successful one is a snapshot even if it brought
    no rows; rows of other days are left out. The first snapshot of a collection gives
    nothing. Of several copies of a key in a snapshot the latest ``latest`` counts (ties: the
    greater content hash). Contents are compared after removing mere differences of writing;
    null equals blank. Rows with a null key are no records. Result: the collection columns,
    ``key``, ``snapshot_day`` (of the later one) and ``change_type``. Empty inputs give no row.

    Rows are shuffled once, by collection and part of the key hash, so that all snapshots of a
    key meet in one task; a collection has a part for about every ``per_part`` of its rows.
    """
    names = [f"_c{i}" for i in range(len(collection))]
    as_names = [F.col(c).alias(n) for c, n in zip(collection, names)]
    sizes = rows.groupBy(*as_names, F.to_date(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    w, whole = W.partitionBy(*names).orderBy("_d"), W.partitionBy(*names)
    pulls = calendar.where(F.col(successful)).select(*as_names, F.to_date(calendar_day).alias("_d")).where(F.col("_d").isNotNull()).distinct().join(sizes, [*names, "_d"], "left")
    pulls = pulls.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_parts", F.ceil(F.greatest(F.sum("_n").over(whole), F.lit(1)) / per_part).cast("int"))
    pulls = pulls.withColumn("_before", F.lag("_d").over(w)).withColumn("_after", F.lead("_d").over(w))
    buckets = lambda other: F.ceil(F.greatest(F.col("_n"), F.coalesce(other, F.lit(0)), F.lit(1)) / (per_bucket * F.col("_parts"))).cast("int")
    pulls = cut_table(pulls.withColumn("_b0", buckets(F.lag("_n").over(w))).withColumn("_b1", buckets(F.lead("_n").over(w))).drop("_n"), "pulls")
    pair = lambda d: F.xxhash64(*names, F.unix_date(d))
    side = lambda d, sign, b: F.when(d.isNotNull(), F.struct(pair(d).alias("pair"), F.lit(sign).alias("sign"), F.pmod(F.shiftright("k", 20), b).cast("int").alias("bucket")))
    newer = side(F.when(F.col("_before").isNotNull(), F.col("_d")), 1, F.col("_b0"))
    older = side(F.col("_after"), -1, F.col("_b1"))

    def elements(only: DataFrame | None) -> DataFrame:
        """The elements of all pairs, or of the given buckets: whose rows alone are then read again."""
        fields = rows.where(F.col(key).isNotNull()).select(*as_names, F.to_date(day).alias("_d"), F.xxhash64(key).alias("k"), F.col(latest).alias("_at"), *content)
        placed = fields.join(bounded_broadcast(pulls), [*names, "_d"]).withColumn("part", F.pmod("k", "_parts").cast("int"))
        if only is not None:
            placed = placed.withColumn("_s", F.array_compact(F.array(newer, older))).select("*", F.explode("_s").alias("_e")).join(only.select(F.col("pair").alias("_p"), F.col("part").alias("_q"), F.col("bucket").alias("_r")), (F.col("_e.pair") == F.col("_p")) & (F.col("part") == F.col("_q")) & (F.col("_e.bucket") == F.col("_r")), "left_semi").drop("_s", "_e").distinct()
        hashed = placed.select(*names, "part", "_d", "k", "_before", "_after", "_b0", "_b1", "_at", F.xxhash64(*[content_only(F.col(c)) for c in content]).alias("v")).repartition(*names, "part")
        one = hashed.groupBy(*names, "part", "_d", "k", "_before", "_after", "_b0", "_b1").agg(F.max(F.struct("_at", "v"))["v"].alias("v"))
        out = one.select(*names, "part", "k", "v", F.explode(F.array_compact(F.array(newer, older))).alias("s")).select(*names, "part", "s.pair", "s.bucket", "s.sign", "k", "v")
        return out if only is None else out.join(only, ["pair", "part", "bucket"], "left_semi").select(*names, "part", "pair", "bucket", "sign", "k", "v")

    net = differences(elements, [*names, "part"])
    kinds = net.groupBy("pair", "k").agg(F.max("sign").alias("_hi"), F.min("sign").alias("_lo"))
    kinds = kinds.select("pair", "k", F.when(F.col("_hi") != F.col("_lo"), "changed").when(F.col("_hi") > 0, "added").otherwise("removed").alias("change_type"))
    day_of = pulls.where(F.col("_before").isNotNull()).select(*names, F.col("_d").alias("snapshot_day"), pair(F.col("_d")).alias("pair"))
    # A collection's key is resolved once, however many snapshots hold it.
    keys = rows.where(F.col(key).isNotNull()).select(*as_names, F.col(key).alias("_key")).distinct().withColumn("k", F.xxhash64("_key"))
    named = kinds.join(bounded_broadcast(day_of), "pair").join(keys, [*names, "k"])
    return named.select(*[F.col(n).alias(c) for n, c in zip(names, collection)], F.col("_key").alias(key), "snapshot_day", "change_type")
