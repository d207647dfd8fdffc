"""Differences of large tables by digests: only parts that differ are compared row by row.

Rows fall into parts by a hash (of their key, or of the whole row), and each part has a digest that doesn't depend on their
order: their number and the sums of two hashes of each. Equal parts have equal digests, so two tables are compared by
digests first, one small row for each part and task, and only rows of parts that differ go through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a table: their list may be sent to every task, and one row that differs costs one part in so many.
PARTS = 1 << 16


def _part(columns: list[str], parts: int):
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def digests(rows: DataFrame, columns: list[str], key: list[str], parts: int = PARTS) -> DataFrame:
    """(part, n, one, two): the digest of each part of `rows`, parted by `key`."""
    whole = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))  # noqa: E731  sums of whole numbers never wrap
    return rows.groupBy(_part(key, parts).alias("part")).agg(F.count("*").alias("n"), whole(1).alias("one"), whole(2).alias("two"))


def where_they_differ(a: DataFrame, b: DataFrame, columns: list[str], key: list[str] | None = None, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """The rows of `a` and of `b` (columns) in parts whose digests differ. With `key`, rows of one key are in one part on both sides."""
    a, b, key = a.select(columns), b.select(columns), key or columns
    x, y = digests(a, columns, key, parts), digests(b, columns, key, parts)
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.one").eqNullSafe(F.col("y.one")) & F.col("x.two").eqNullSafe(F.col("y.two"))
    differ = x.alias("x").join(y.alias("y"), F.col("x.part") == F.col("y.part"), "full").where(~same).select(F.coalesce("x.part", "y.part").alias("part_"))
    return tuple(f.join(F.broadcast(differ), _part(key, parts) == F.col("part_"), "left_semi") for f in (a, b))
