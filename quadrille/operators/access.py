"""Access paths over triples(s, p, o): entities, predicates, neighbours, existence, and where a vertex lives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.setops import listed

OUT, IN = "OUT", "IN"


def _ends(direction: str) -> tuple[str, str]:
    if direction not in (OUT, IN):
        raise ValueError(f"direction is OUT or IN, not {direction!r}")
    return ("s", "o") if direction == OUT else ("o", "s")


def entities(triples: DataFrame, predicates: str | list, direction: str = OUT) -> DataFrame:
    """v: vertices with an edge of one of the predicates in that direction."""
    v, _ = _ends(direction)
    ps = [predicates] if isinstance(predicates, (str, int)) else list(predicates)
    return triples.where(F.col("p").isin(*ps)).select(F.col(v).alias("v")).distinct()


def class_members(triples: DataFrame, cls, type_predicate="rdf:type") -> DataFrame:
    """v: the class index."""
    return triples.where((F.col("p") == type_predicate) & (F.col("o") == cls)).select(F.col("s").alias("v")).distinct()


def predicates(triples: DataFrame, vertex, direction: str = OUT) -> DataFrame:
    v, _ = _ends(direction)
    return triples.where(F.col(v) == vertex).select("p").distinct()


def neighbours(triples: DataFrame, vertex, predicate=None, direction: str = OUT) -> DataFrame:
    """v: ends of the vertex's edges, of one predicate or of all."""
    v, other = _ends(direction)
    rows = triples.where(F.col(v) == vertex)
    rows = rows if predicate is None else rows.where(F.col("p") == predicate)
    return rows.select(F.col(other).alias("v")).distinct()


def neighbourhood(triples: DataFrame, vertex) -> DataFrame:
    """v: one hop in either direction."""
    return neighbours(triples, vertex).unionAll(neighbours(triples, vertex, direction=IN)).distinct()


def adjacency(triples: DataFrame, direction: str = OUT, block: int = 1 << 16) -> DataFrame:
    """(v, p, d, block, o_vals): grouped rows, neighbours sorted and distinct, at most `block` of them in a row.  For the API's edge;
    keep triples exploded inside plans."""
    v, other = _ends(direction)
    rows = listed(triples.select(F.col(v).alias("v"), "p", F.col(other).alias("o")), ["v", "p"], "o", "o_vals", block)
    return rows.select("v", "p", F.lit(direction).alias("d"), "block", "o_vals")


def star_reply(triples: DataFrame, sources: DataFrame, predicates: list, block: int = 1 << 16) -> DataFrame:
    """(s, block, edges): for each of sources(v) its star as one nested value, [(p, [neighbours])]; a source of many neighbours has several rows."""
    rows = triples.where(F.col("p").isin(*predicates)).join(sources.select(F.col("v").alias("s")), "s", "left_semi")
    lists = listed(rows, ["s", "p"], "o", "o_vals", block)
    return lists.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("p", "o_vals"))).alias("edges"))


def exists(triples: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertices(v) that occur as a subject or an object."""
    known = triples.select(F.col("s").alias("v")).unionAll(triples.select(F.col("o").alias("v")))
    return vertices.join(known, "v", "left_semi")


def locate(vertices: DataFrame, home: Column, overrides: DataFrame | None = None) -> DataFrame:
    """(v, server): the override where there is one, else home, an expression of column v."""
    base = vertices.select("v").distinct()
    if overrides is None:
        return base.select("v", home.alias("server"))
    return base.join(overrides.select("v", F.col("server").alias("_at")), "v", "left").select("v", F.coalesce("_at", home).alias("server"))


def by_server(located: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(server, block, vs): vertices of each server, sorted, at most `block` of them in a row."""
    return listed(located, ["server"], "v", "vs", block)


def servers_of_predicate(triples: DataFrame, predicate, home: Column, direction: str = OUT, overrides: DataFrame | None = None) -> DataFrame:
    """server: where a vertex with such an edge lives."""
    return locate(entities(triples, predicate, direction), home, overrides).select("server").distinct()
