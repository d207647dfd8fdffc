from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.operators import browse, compare, load

KIND = "id int, name string, x double"


def table(rng, n):
    return [(rng.randrange(40), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_differences_are_those_of_except_all(spark, seed):
    """Repeated rows, nulls, both zeros and not-a-number; columns in another order; equal tables and empty ones."""
    rng = random.Random(seed)
    one = table(rng, 300)
    two = one[:]
    for _ in range(seed * 3):
        two[rng.randrange(len(two))] = table(rng, 1)[0]
    two += one[:seed]
    rng.shuffle(two)
    a, b = spark.createDataFrame(one, KIND), spark.createDataFrame(two, KIND).select("x", "id", "name")
    columns = ["id", "name", "x"]
    want = a.exceptAll(b.select(columns)).withColumn("side", F.lit("a")).union(b.select(columns).exceptAll(a).withColumn("side", F.lit("b")))
    plain = lambda f: rows(f, "id", "name", (F.col("x") + 0.0).cast("string"), "side")  # noqa: E731  both zeros are equal, and so are not-a-numbers
    assert plain(browse.regression_diff(a.repartition(3), b.repartition(5), columns)) == plain(want)
    assert plain(browse.regression_diff(a, a.limit(0), columns)) == plain(a.withColumn("side", F.lit("a")))


def test_only_parts_that_differ_are_compared(spark):
    a = spark.range(20_000).select(F.col("id").cast("int").alias("id"), F.lit("a").alias("name"), F.lit(0.5).alias("x"))
    x, y = compare.where_they_differ(a, a.orderBy(F.desc("id")), a.columns)
    assert x.isEmpty() and y.isEmpty()
    b = a.withColumn("name", F.when(F.col("id") == 77, "b").otherwise(F.col("name")))
    x, y = compare.where_they_differ(a, b, a.columns)
    assert 1 <= x.count() <= 10 and 1 <= y.count() <= 10 and not x.where("id = 77").isEmpty()
    # Twice a row for two others: sums and counts tell them apart.
    c, d = (spark.createDataFrame([(v, "a", 0.5) for v in values], KIND) for values in ((1, 1, 2, 2), (1, 2, 1, 2)))
    assert browse.regression_diff(c, d, c.columns).isEmpty()
    c, d = (spark.createDataFrame([(v, "a", 0.5) for v in values], KIND) for values in ((1, 1), (2, 2)))
    assert rows(browse.regression_diff(c, d, c.columns), "id", "side") == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]


def test_changed_nodes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1"), ("e", None)], "id string, etag string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1"), ("f", None)], "id string, etag string")
    assert rows(load.changed_nodes(old, new)) == [("b", "changed"), ("d", "removed"), ("e", "changed"), ("f", "new")]
    assert load.changed_nodes(old, old).isEmpty()
