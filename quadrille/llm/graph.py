"""Connected components of an edge list with DataFrame operations alone: alternating large-star and small-star rounds.

Every round is written to the shared folder, so lineage stays short and lost executors cost little.  Hubs are reduced by partial
aggregation; the joins have one row for each node on one side, so Spark can split a skewed other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a long, b long), either direction, repeats and loops allowed -> (node, component): the smallest node reachable.
    Nodes that no edge names are absent."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = C.materialise(e, name)
    state = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = C.materialise(small.select("x.u", "x.v").where("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
