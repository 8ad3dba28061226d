"""Statistics: predicates, vertices, servers, co-traversal counters (DoI), weights, edge cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predicate_stats(triples: DataFrame) -> DataFrame:
    """(p, n_triples, n_subjects, n_objects) of a set of triples, in one pass: Spark counts distinct values by (p, value) before it
    counts by p, so a predicate that holds most triples is spread over tasks."""
    return triples.groupBy("p").agg(F.count("*").alias("n_triples"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


def planner_stats(triples: DataFrame) -> dict[str, tuple[int, int, int]]:
    """For the planner: one entry for each predicate."""
    return {r.p: (r.n_triples, r.n_subjects, r.n_objects) for r in predicate_stats(triples).collect()}


def predicate_servers(triples: DataFrame, located: DataFrame, column: str = "s") -> DataFrame:
    """(p, server, n): distinct vertices of each predicate on each server; located(v, server)."""
    pairs = triples.select("p", F.col(column).alias("v")).distinct()
    return pairs.join(located, "v").groupBy("p", "server").agg(F.count("*").alias("n"))


def vertex_stats(triples: DataFrame) -> DataFrame:
    """(v, n_edges, n_objects): edges in either direction, distinct neighbours outward."""
    none = F.lit(None).cast(triples.schema["o"].dataType)
    ends = F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("o")), F.struct(F.col("o").alias("v"), none.alias("o")))).alias("x")
    both = triples.select(ends).select("x.v", "x.o")  # one pass over the triples
    return both.groupBy("v").agg(F.count("*").alias("n_edges"), F.countDistinct("o").alias("n_objects"))


def doi(edges: DataFrame, located: DataFrame) -> DataFrame:
    """(v, server, cnt): how often traversal on a server touched a vertex.  edges(s, p, d, o) are result edges; each adds one to
    its source and one to its target, on the server of its source."""
    at = edges.join(located.select(F.col("v").alias("s"), "server"), "s")
    touched = at.select(F.explode(F.array("s", "o")).alias("v"), "server")
    return touched.groupBy("v", "server").agg(F.count("*").alias("cnt"))


def doi_wide(counts: DataFrame, servers: int) -> DataFrame:
    """(v, s0, s1, ...): a column for each server, 0 where nothing was counted."""
    return counts.groupBy("v").pivot("server", list(range(servers))).agg(F.sum("cnt")).na.fill(0).toDF("v", *[f"s{i}" for i in range(servers)])


def add_weights(weights: DataFrame, increments: DataFrame, *keys: str) -> DataFrame:
    """weights(keys, weight) with increments(keys, weight) added: vertex weights with one key, edge weights with two."""
    keys = keys or ("v",)
    return weights.select(*keys, "weight").unionAll(increments.select(*keys, "weight")).groupBy(*keys).agg(F.sum("weight").alias("weight"))


def server_stats(vertices: DataFrame, located: DataFrame) -> DataFrame:
    """(server, n_vertices, n_edges, n_objects) of vertices(v, n_edges, n_objects)."""
    return vertices.join(located, "v").groupBy("server").agg(F.count("*").alias("n_vertices"), F.sum("n_edges").alias("n_edges"), F.sum("n_objects").alias("n_objects"))


def edge_cut(edges: DataFrame, located: DataFrame) -> DataFrame:
    """(server, cut): for each server the distinct targets of its result edges (s, o) that live elsewhere."""
    a = located.select(F.col("v").alias("s"), "server")
    b = located.select(F.col("v").alias("o"), F.col("server").alias("other"))
    return edges.select("s", "o").distinct().join(a, "s").join(b, "o").where("server <> other").select("server", "o").distinct().groupBy("server").agg(F.count("*").alias("cut"))


def run_summary(log: DataFrame) -> DataFrame:
    """(query, elapsed, eval_time, edge_cut) of a log with a row for each plan: slowest plan, sum of the cuts."""
    return log.groupBy("query").agg(F.max("elapsed").alias("elapsed"), F.max("eval_time").alias("eval_time"), F.sum("edge_cut").alias("edge_cut"))
