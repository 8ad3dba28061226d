"""Streaming forms of the deferred statistics: weights and counters that follow a stream of result edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vertex_weights(edges: DataFrame) -> DataFrame:
    """edges(s, ...): running (v, weight), an addition for each edge evaluated; for update or complete output."""
    return edges.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("weight"))


def edge_weights(edges: DataFrame, limit: int = 0) -> DataFrame:
    """(v1, v2, weight) of a log of edges(s, o); limit: only so many of the latest entries of a batch log (seq, s, o) count, 0 means all."""
    if limit:
        edges = edges.orderBy(F.col("seq").desc()).limit(limit)
    return edges.groupBy(F.col("s").alias("v1"), F.col("o").alias("v2")).agg(F.count("*").alias("weight"))


def windowed_weights(edges: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """edges(ts, s, ...): (start, v, weight) of tumbling windows; state is dropped behind the watermark."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("s").alias("v")).agg(F.count("*").alias("weight")).select(F.col("window.start").alias("start"), "v", "weight")


def replace_each_batch(path: str):
    """A foreachBatch function that writes each batch under its own number, so a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
