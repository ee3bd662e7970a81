import hashlib

import pytest
from pyspark.sql import functions as F

from murmuration.operators import sampling
from murmuration.operators.skew import by_bounds, exact_sample, global_rank, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 977).cast("string")))
    return spark.range(20_000).withColumn("key", key)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(skewed, how):
    small = skewed.groupBy("key").count().where("key != 'k5'").withColumn("value", F.length("key"))
    fast = skew_join(skewed, small, "key", "count", "id", how).select("id", "key", "count", "value")
    plain = skewed.join(small, "key", how).select("id", "key", "count", "value")
    assert fast.count() == plain.count()
    assert fast.exceptAll(plain).isEmpty()


def test_hot_key_is_cut_into_pieces(skewed):
    small = skewed.groupBy("key").count()
    joined = skew_join(skewed, small, "key", "count", "id")
    assert "_pieces" in joined._jdf.queryExecution().optimizedPlan().toString()


def brute_sample(rows, by, wanted):
    groups = {}
    for row in rows:
        groups.setdefault(row[1] if by else None, []).append(row[0])
    kept = set()
    for ids in groups.values():
        order = sorted(ids, key=lambda i: hashlib.md5(f"4:{i}".encode()).hexdigest())
        kept.update(order[: wanted(len(ids))])
    return kept


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sample_per_group(skewed, parts):
    rows = [(r.id, r.key) for r in skewed.collect()]
    got = {r.id for r in exact_sample(skewed.repartition(parts), "id", 4, fraction=0.37, by="key").collect()}
    assert got == brute_sample(rows, True, lambda n: int(n * 0.37))


@pytest.mark.parametrize("size", [0, 1, 999, 20_000, 50_000])
def test_exact_sample_of_size(skewed, size):
    rows = [(r.id, r.key) for r in skewed.collect()]
    got = {r.id for r in exact_sample(skewed, "id", 4, size=size).collect()}
    assert got == brute_sample(rows, False, lambda n: size)


@pytest.mark.parametrize("rows_per_task", [300, 5_000, 2_000_000])
def test_global_rank(spark, rows_per_task):
    ids = spark.range(5_000).select((F.col("id") * F.col("id") + 3).alias("id")).repartition(5)
    ranked = global_rank(ids, "id", "r", rows_per_task).collect()
    assert sorted((r.r, r.id) for r in ranked) == [(i + 1, i * i + 3) for i in range(5_000)]


def test_shuffle_and_restore(spark):
    rows = spark.range(100)
    mixed = [r.id for r in sampling.shuffled(rows, "id", 9).orderBy("position").collect()]
    assert mixed != sorted(mixed) and sorted(mixed) == list(range(100))


def test_one_per_group(skewed):
    picks = sampling.one_per_group(skewed, "id", "key", 1)
    assert picks.count() == skewed.select("key").distinct().count()
    assert picks.join(skewed, ["id", "key"]).count() == picks.count()


def test_null_is_a_group(spark):
    rows = spark.range(100).withColumn("key", F.when(F.col("id") % 2 == 0, F.lit("a")))
    counts = {r.key: r["count"] for r in exact_sample(rows, "id", 1, fraction=0.5, by="key").groupBy("key").count().collect()}
    assert counts == {"a": 25, None: 25}


def test_bounds_of_long_numbers(spark):
    base = 1_250_000_000_000_000_000
    placed = by_bounds(spark.range(base, base + 10).union(spark.sql("SELECT CAST(NULL AS BIGINT) AS id")), "id", [base + 3, base + 4], "piece")
    assert [r.piece for r in placed.orderBy("id").collect()] == [0, 0, 0, 0, 1, 2, 2, 2, 2, 2, 2]


def test_scratch_tables_go_when_told(spark):
    from murmuration.session import _MADE, clear_scratch, cut_lineage

    kept = dict(_MADE)
    _MADE.clear()
    cut_lineage(spark.range(3), "gone").count()
    assert clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    _MADE.update(kept)
