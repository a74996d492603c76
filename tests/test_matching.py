"""Blocked pairs against brute force, on duplicates, nulls, blocks of several chunks and small tables with many pairs."""

import duckdb
import pytest

from sightline.operators import matching
from sightline.plans import catalogue

ROWS = [(i * 7 % 101, [None, "a b", "a b c", "b a", "", "é è"][i % 6], [None, "x", "y"][i % 11 % 3], i % 2) for i in range(240)] + [(7, "a b", "x", 1), (7, "a b c", "y", 1), (None, "a b", "x", 1)]


def brute(text):
    """Keys a < b of one block and their texts, as a join on the block lists them."""
    return sorted(((k, m, t, u) for k, t, x, s in ROWS for m, u, y, r in ROWS if None not in (k, m, x, y) and (x, s) == (y, r) and k < m), key=str)


@pytest.fixture
def part(spark, tmp_path):
    """A folder whose part and lineitem have such rows: few names in one block with thousands of pairs."""
    spark.createDataFrame(ROWS, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k % 101, [None, 1, 2, 3, 4][k * k % 23 % 5]) for k in range(300)] + [(None, 1), (3, None), (10, None)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(catalogue.ORACLE[name]).fetchall(), key=str)


@pytest.mark.parametrize("chunk_rows", [1, 7, 4096])
def test_texts_of_a_block_meet_once_and_their_keys_are_all_listed(spark, chunk_rows):
    df = spark.createDataFrame(ROWS, "k long, t string, x string, s int")
    texts = matching.blocked_texts(df, "k", ["x", "s"], "t", chunk_rows)
    got = matching.pair_keys(texts, "k").select("k_a", "k_b", "t_a", "t_b").collect()
    assert sorted(map(tuple, got), key=str) == brute("t")
    assert chunk_rows != 4096 or texts.count() <= 4 * 6 * 6


@pytest.mark.parametrize("name", ["fuzzy_jaccard_candidates", "fuzzy_jaro_winkler"])
def test_pairs_of_a_small_table_are_many_tasks(spark, part, name):
    got = catalogue.QUERIES[name](spark, part)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(part, name)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("chunk_rows", [1, 7, 512])
def test_pairs_without_a_shared_value_are_never_shuffled(spark, part, chunk_rows):
    read = lambda t: spark.read.parquet(f"{part}/{t}.parquet")
    got = matching.unshared_pairs(read("part"), "p_partkey", ["p_brand", "p_size"], read("lineitem"), "l_partkey", "l_suppkey", chunk_rows)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(part, "shared_supplier_veto") != []


def test_shared_supplier_veto_equals_its_sql_on_nulls_and_duplicates(spark, part):
    assert sorted(map(tuple, catalogue.shared_supplier_veto(spark, part).collect()), key=str) == by_sql(part, "shared_supplier_veto")


def test_mutual_best_merge_scores_texts_not_pairs_of_rows(spark, part):
    got = catalogue.mutual_best_merge(spark, part)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(part, "mutual_best_merge")
    assert "p_partkeys_a" in got._jdf.queryExecution().toString()


def most_rows(node):
    """The most rows that a step of an executed plan gave."""
    counted, name = node.metrics().get("numOutputRows"), node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    below = [node.children().apply(i) for i in range(node.children().size())]
    return max([counted.get().value() if counted.isDefined() else 0, *map(most_rows, inner + below)])


def test_mutual_best_merge_lists_no_pairs_of_rows(spark, part):
    got = catalogue.mutual_best_merge(spark, part)
    assert len(got.collect()) == len(by_sql(part, "mutual_best_merge"))
    assert most_rows(got._jdf.queryExecution().executedPlan()) <= 2 * len(ROWS)


@pytest.mark.parametrize("chunk_rows", [1, 2, 4096])
def test_best_partners_found_by_text_equal_the_sql_on_nulls_and_duplicates(spark, part, chunk_rows):
    got = matching.mutual_best_texts(spark.read.parquet(f"{part}/part.parquet"), "p_partkey", ["p_brand", "p_size"], "p_name", 50.0, chunk_rows)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(part, "mutual_best_merge") != []
