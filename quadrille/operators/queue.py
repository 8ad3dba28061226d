"""Work that is put off: a queue of vertices to reassign and statistics tasks, as tables that jobs append to and take from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_WEIGHT, VERTEX_WEIGHT, DOI = 0, 1, 2  # kinds of tasks
QUEUE = "round long, server long, v long"
TASKS = "kind int, a long, b long, server long, amount long"


def push(queue: DataFrame, new: DataFrame, number: int, deduplicate: bool = True) -> DataFrame:
    """queue(round, server, v) with new(server, v) at its end, as round `number`.  Deduplicating, a vertex that waits for its server
    already, or stands twice in new, waits once; else every row is added."""
    rows = new.select("server", "v")
    if deduplicate:
        rows = rows.distinct().join(queue.select("server", "v"), ["server", "v"], "left_anti")
    return queue.select("round", "server", "v").unionAll(rows.select(F.lit(number).cast("long"), F.col("server").cast("long"), F.col("v").cast("long")))


def pop(queue: DataFrame, n: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first n entries of each server, oldest round first, and what is left.  Spark keeps n rows of each task before it deals them by server."""
    place = F.row_number().over(Window.partitionBy("server").orderBy("round", "v"))
    taken = queue.withColumn("place", place).where(F.col("place") <= n)
    last = taken.groupBy("server").agg(F.max(F.struct("round", "v")).alias("last"))
    # Equal entries stand side by side: of the last one taken, as many stay as were not taken.
    same = queue.join(last, "server").where((F.col("round") == F.col("last.round")) & (F.col("v") == F.col("last.v"))).select("server", "round", "v")
    here = taken.join(last, "server").where((F.col("round") == F.col("last.round")) & (F.col("v") == F.col("last.v"))).select("server", "round", "v")
    rest = queue.join(last, "server", "left").where(F.col("last").isNull() | (F.struct("round", "v") > F.col("last"))).select("round", "server", "v")
    return taken.select("round", "server", "v"), rest.unionAll(same.exceptAll(here).select("round", "server", "v"))


def waiting(queue: DataFrame) -> DataFrame:
    """(server, n): entries that wait."""
    return queue.groupBy("server").agg(F.count("*").alias("n"))


def tasks(kind: int, rows: DataFrame) -> DataFrame:
    """Statistics tasks of one kind: rows(a, b, server, amount), of which an edge weight needs a and b, a vertex weight a, a counter of
    co-traversal a and server."""
    if kind not in (EDGE_WEIGHT, VERTEX_WEIGHT, DOI):
        raise ValueError(f"no kind of task {kind!r}")
    need = {EDGE_WEIGHT: ("a", "b"), VERTEX_WEIGHT: ("a",), DOI: ("a", "server")}[kind]
    cols = [F.col(c).cast("long") if c in need else F.lit(None).cast("long").alias(c) for c in ("a", "b", "server")]
    return rows.select(F.lit(kind).alias("kind"), *cols, F.col("amount").cast("long"))


def apply_tasks(todo: DataFrame, edge_weights: DataFrame, vertex_weights: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edge_weights(v1, v2, weight), vertex_weights(v, weight) and counts(v, server, cnt) after the tasks."""
    of = lambda k, *c: todo.where(F.col("kind") == k).select(*c)
    e = edge_weights.unionAll(of(EDGE_WEIGHT, "a", "b", "amount")).groupBy("v1", "v2").agg(F.sum("weight").alias("weight"))
    v = vertex_weights.unionAll(of(VERTEX_WEIGHT, "a", "amount")).groupBy("v").agg(F.sum("weight").alias("weight"))
    d = counts.unionAll(of(DOI, "a", "server", "amount")).groupBy("v", "server").agg(F.sum("cnt").alias("cnt"))
    return e, v, d
