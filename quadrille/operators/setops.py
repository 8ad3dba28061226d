"""Set and multiset operations on frames of one value column or of triples, and their orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame, multiset: bool = True) -> DataFrame:
    return a.intersectAll(b) if multiset else a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose value is not in b; those that stay keep their repeats."""
    return a.join(b, a.columns, "left_anti")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def intersect_many(*frames: DataFrame) -> DataFrame:
    """Values in all frames, by semi-joins from the first, which should be the smallest."""
    return reduce(lambda x, y: x.join(y, x.columns, "left_semi"), frames[1:], frames[0].distinct())


def sorted_distinct(a: DataFrame) -> DataFrame:
    return a.distinct().orderBy(*a.columns)


def listed(rows: DataFrame, keys: list[str], value: str, into: str, block: int = 1 << 16) -> DataFrame:
    """(keys, block, into): the sorted distinct values of each key as arrays of at most `block` values, so a key that holds most
    rows fills many rows, not one task.  Rows are range-partitioned and numbered within their partitions; a key's blocks follow each other in
    the order of their numbers."""
    rows = rows.select(*keys, value).distinct().repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    numbered = rows.withColumn("block", F.expr(f"monotonically_increasing_id() div {block}"))
    return numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(value)).alias(into))


def dedup_adjacency(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(v, p, d, block, o_vals): neighbours of each (v, p, d) united, in blocks."""
    return listed(rows.select("v", "p", "d", F.explode("o_vals").alias("o")), ["v", "p", "d"], "o", "o_vals", block)


def spo(triples: DataFrame) -> DataFrame:
    return triples.orderBy("s", "p", "o")


def ops(triples: DataFrame) -> DataFrame:
    return triples.orderBy("o", "p", "s")


def spd(rows: DataFrame) -> DataFrame:
    return rows.orderBy("s", "p", "d")


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The table with these rows put in the place of those with the same keys."""
    return table.join(rows, list(keys), "left_anti").select(*table.columns).unionAll(rows.select(*table.columns))


def add_scored(members: DataFrame, rows: DataFrame, keep: bool = False) -> DataFrame:
    """An ordered set (v, score) with rows(v, score) added: of a member that stands there the higher score stays, or (keep) its own."""
    if keep:
        rows = rows.join(members, "v", "left_anti")
    return members.unionByName(rows).groupBy("v").agg(F.max("score").alias("score"))


def batch(queue: DataFrame, n: int = 1000) -> DataFrame:
    """The oldest n entries of a queue (seq, ...)."""
    return queue.orderBy("seq").limit(n)
