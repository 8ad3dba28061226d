"""Workload-aware placement: targets by co-traversal counts or by a balance-constrained score, triggers, and moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Settings; reassigning is on unless switched off, as documented for each run."""

    servers: int = 3
    enable_reassign: bool = True
    trigger_k: int = 2
    trigger_double: bool = False
    gamma: float = 1.1
    beta: float = 1.0
    log_limit: int = 0  # 0: unlimited


def doi_target(counts: DataFrame, located: DataFrame) -> DataFrame:
    """(v, current, target): the server with the highest count; the current one wins ties, then the smaller number."""
    current = located.withColumnRenamed("server", "current")
    ranked = counts.join(current, "v").withColumn("rank", F.struct((-F.col("cnt")).alias("a"), (F.col("server") != F.col("current")).alias("b"), F.col("server").alias("c")))
    best = ranked.groupBy("v", "current").agg(F.min("rank").alias("m"), F.max("cnt").alias("top"))
    return best.select("v", "current", F.when(F.col("top") > 0, F.col("m.c")).otherwise(F.col("current")).alias("target"))


def balance_score(source_weight, server_weight, active, average, own, locality, c: Config = Config()) -> Column:
    """Locality less a load penalty; minus infinity where a move would leave the source too light or the server too heavy.
    The penalty divides whole numbers without remainder; a server without active objects has none."""
    cols = [F.col(x) if isinstance(x, str) else F.lit(x) if not isinstance(x, Column) else x for x in (source_weight, server_weight, active, average, own, locality)]
    src, srv, act, avg, o, loc = cols
    barred = (src - o < avg * (2 - c.gamma)) | (srv + o > avg * c.gamma)
    share = F.floor(srv / F.when(act != 0, F.lit(c.servers) * act))
    return F.when(barred, F.lit(float("-inf"))).when(act == 0, loc.cast("double")).otherwise(loc - F.lit(float(c.beta)) * share)


def triggered(previous, weight, c: Config = Config()) -> Column:
    """Whether a vertex's weight has grown enough since it was last moved: by k at first; later by k again, or doubled."""
    p, w = (F.col(x) if isinstance(x, str) else x for x in (previous, weight))
    grown = w - p
    return F.when(p == 0, w >= c.trigger_k).otherwise(grown >= p if c.trigger_double else grown >= c.trigger_k)


def balance_target(candidates: DataFrame, c: Config = Config()) -> DataFrame:
    """(v, target): candidates(v, server, current, edges, previous, weight, source_weight, server_weight, active, average, own,
    locality, and optionally elsewhere) hold a row for each server.  Vertices without edges or locality, or not triggered, or that
    live on another server than the one that asks (elsewhere), do not move (target null); the current server wins ties."""
    scored = candidates.withColumn("score", balance_score("source_weight", "server_weight", "active", "average", "own", "locality", c))
    w = Window.partitionBy("v").orderBy(F.col("score").desc(), (F.col("server") != F.col("current")), "server")
    best = scored.withColumn("local", F.max("locality").over(Window.partitionBy("v"))).withColumn("n", F.row_number().over(w)).where("n = 1")
    move = (F.col("edges") > 0) & (F.col("local") > 0) & triggered("previous", "weight", c) & (F.col("score") > float("-inf")) & F.lit(c.enable_reassign)
    if "elsewhere" in candidates.columns:
        move &= ~F.coalesce("elsewhere", F.lit(False))
    return best.select("v", F.when(move, F.col("server")).alias("target"))


def move(overrides: DataFrame, moves: DataFrame, home: Column) -> DataFrame:
    """overrides(v, server) after moves(v, target): the latest place, dropped where it is the vertex's home."""
    kept = overrides.join(moves, "v", "left_anti").select("v", "server")
    return kept.unionAll(moves.where("target is not null").select("v", F.col("target").cast(overrides.schema["server"].dataType).alias("server"))).where(F.col("server") != home)


def plan_round(edges: DataFrame, overrides: DataFrame, located: DataFrame, home: Column) -> DataFrame:
    """One round of moves by co-traversal: counts from result edges(s, p, d, o), targets, new overrides."""
    from quadrille.operators.stats import doi

    target = doi_target(doi(edges, located), located).where("target <> current").select("v", "target")
    return move(overrides, target, home)


# ---------------------------------------------------------------- placement by file, counters that follow moves, rounds


def placed_by(vertices: DataFrame, partition: DataFrame, home: Column) -> tuple[DataFrame, DataFrame]:
    """Initial placement by a file's partition(v, server): (v, server) of the vertices, and the overrides to keep: those not at home."""
    placed = vertices.select("v").distinct().join(partition.select("v", F.col("server").alias("_at")).dropDuplicates(["v"]), "v", "left")
    placed = placed.select("v", F.coalesce("_at", home).alias("server"))
    return placed, placed.where(F.col("server") != home)


def members(vertices: DataFrame, partition: DataFrame, server: int) -> DataFrame:
    """The vertices that a partition file gives to a server."""
    return vertices.join(partition.where(F.col("server") == server).select("v"), "v", "left_semi")


def place_all(overrides: DataFrame, vertices: DataFrame, server: int, home: Column) -> DataFrame:
    """overrides(v, server) after all these vertices were put on one server."""
    return move(overrides, vertices.select("v").distinct().withColumn("target", F.lit(server)), home)


def follow_moves(counts: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """counts(v, server, cnt) after moves(v, source, target): what the result edges (s, o) of a moved vertex counted on its old server
    counts on its new one, at both of their ends.  Equal to counting anew, but reads the edges of moved vertices alone."""
    own = edges.select("s", "o").join(moves.select(F.col("v").alias("s"), "source", "target"), "s")
    ends = own.select(F.explode(F.array("s", "o")).alias("v"), "source", "target")
    step = lambda c, n: F.struct(F.col(c).cast("long").alias("server"), F.lit(n).cast("long").alias("cnt"))
    delta = ends.select("v", F.explode(F.array(step("source", -1), step("target", 1))).alias("x")).select("v", "x.server", "x.cnt")
    both = counts.select("v", F.col("server").cast("long").alias("server"), "cnt").unionAll(delta)
    return both.groupBy("v", "server").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def drop_counts(counts: DataFrame, vertices: DataFrame) -> DataFrame:
    """counts without those of these vertices."""
    return counts.join(vertices.select("v"), "v", "left_anti")


def reassign_info(vertices: DataFrame, counts: DataFrame, located: DataFrame, weights: DataFrame, c: Config = Config()) -> DataFrame:
    """A row for each vertex and server with what the balance score asks for: vertices(v, n_edges, n_objects), counts(v, server, cnt),
    located(v, server), weights(v, weight, previous).  A server's weight is the sum of what it co-traversed, its active objects those
    vertices of which it co-traversed some."""
    servers = F.explode(F.array(*[F.lit(i).cast("long") for i in range(c.servers)])).alias("server")
    at = located.select("v", F.col("server").cast("long").alias("current"))
    long = at.select("v", "current", servers).join(counts.select("v", F.col("server").cast("long").alias("server"), "cnt"), ["v", "server"], "left")
    long = long.select("v", "server", "current", F.coalesce("cnt", F.lit(0)).alias("locality"))
    per = long.groupBy("server").agg(F.sum("locality").alias("server_weight"), F.sum((F.col("locality") > 0).cast("long")).alias("active"))  # a row for each server
    source = per.select(F.col("server").alias("current"), F.col("server_weight").alias("source_weight"))
    mean = per.agg((F.sum("server_weight") / c.servers).alias("average"))
    own = long.groupBy("v").agg(F.sum("locality").alias("own"))
    seen = vertices.select("v", F.col("n_edges").alias("edges"), F.col("n_objects").alias("objects")).join(weights, "v", "left")
    seen = seen.join(own, "v").select("v", "edges", "objects", "own", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("previous", F.lit(0)).alias("previous"))
    return long.join(seen, "v").join(F.broadcast(per), "server").join(F.broadcast(source), "current").crossJoin(F.broadcast(mean))


def rounds(edges: DataFrame, vertices: DataFrame, overrides: DataFrame, home: Column, most: int = 10, batch: int = 1000, c: Config = Config()) -> tuple[DataFrame, list[int]]:
    """Rounds of moves by co-traversal until none is left, `most` at most: overrides(v, server) and the moves of each round.  Vertices that
    want to move wait in a queue for their server, which takes `batch` a round; each round's state is stored."""
    from quadrille.operators import queue as q
    from quadrille.operators.access import locate
    from quadrille.operators.stats import doi
    from quadrille.sources.triples import stored

    spark, done = edges.sparkSession, []
    if not c.enable_reassign:
        return overrides, done
    waiting = spark.createDataFrame([], q.QUEUE)
    located = locate(vertices, home, overrides)
    counts = stored(doi(edges, located), "round-counts")
    for i in range(most):
        located = locate(vertices, home, overrides)
        wish = stored(doi_target(counts, located).where("target <> current"), "round-targets")
        waiting = q.push(waiting, wish.select(F.col("current").alias("server"), "v"), i)
        taken, rest = q.pop(waiting, batch)
        # Whoever waits for long may not want to go any more: targets are those of now.
        moves = stored(taken.select("v").distinct().join(wish, "v").select("v", F.col("current").alias("source"), "target"), "round-moves")
        done.append(moves.count())
        if not done[-1]:
            break
        overrides = stored(move(overrides, moves.select("v", "target"), home), "round-overrides")
        counts = stored(follow_moves(counts, edges, moves), "round-counts")
        waiting = stored(rest, "round-queue")
    return overrides, done
