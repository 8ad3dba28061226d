"""Operator 6: embedding near-dedup by a forest of random-projection trees.

Equal vectors are one node.  Trees are grown on a sample of at most SAMPLE nodes: each split projects on the difference of two random
points and cuts at the median; points within the spill band around it go to both sides.  Every node is sent to its leaves in all
trees.  Where a leaf of the sample stands for more than 4 * LEAF nodes, it is split again, in further rounds, each by a sample of
that leaf's own, so leaves are small whatever the table.  Points most of whose pairs are links are not split: such a dense leaf of more
than WIDE nodes is compared in pairs of groups, each a task's work of its own.  Leaves compare all their nodes in double
precision, in blocks, so no pair is emitted: a leaf gives each node its number of links and the edges of a spanning forest.  Pairs that
meet in several leaves count in the first of them only, which both sides know from their lists of leaves.  Components are the
union of all edges.

Links are those with cosine >= 0.9 that meet in some leaf; none below is reported.  Trees deepen with the table, so their number follows
their depth: of pairs at cosine 0.9005 in 64 dimensions a split parts 8.4 %, and the trees are as many as leave one in 2000
unseen.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; a null vec_id links with nothing and has a null component; every row is a vector of its own: rows of one vec_id link
if their vectors do (equal ones are copies), and otherwise have nothing to do with each other but that a component is named by its
smallest vec_id; an empty table gives no rows; labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C
from quadrille.llm.graph import components
from quadrille.llm.ngram_join import Union

TREES = 10  # at least
TOGETHER = 0.916  # share of pairs at cosine 0.9005 that a split leaves together, as measured on 64 dimensions
MISS = 5e-4  # of such pairs, what no tree may keep together
LEAF = 256
SPILL = 0.04  # share of a node's points, on either side of the cut, that go both ways
SAMPLE = 16_384
DENSE = 0.9  # a set of points is dense if half of its pairs have this cosine
WIDE = 8192  # nodes of a dense leaf that one task compares
ROUNDS = 12  # of splitting; each divides a leaf by up to SAMPLE / 6
BLOCK = 512


def trees_for(count: int, leaf: int) -> int:
    """Trees that so many points need, split down to that leaf: deeper trees part more pairs."""
    depth = max(0.0, math.log(max(count, 1) / leaf) / -math.log(0.5 + SPILL))
    alone = 1 - TOGETHER**depth
    return TREES if alone <= 0 else max(TREES, math.ceil(math.log(MISS) / math.log(alone)))


def _dense(x: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> bool:
    """Whether half of the pairs of these points are links, by 64 of them."""
    i, j = rng.choice(own, (2, 64))
    return bool(((x[i] * x[j]).sum(1) >= DENSE)[i != j].sum() >= 32)


class Forest:
    """Split directions and bands by (tree, node); leaves are numbered throughout the forest, in order of the trees."""

    def __init__(self, sample: np.ndarray, leaf: int, trees: int = TREES, spill: float = SPILL, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.splits: list[tuple[np.ndarray, float, float, int, int]] = []  # direction, band, children: split >= 0, leaf < 0
        self.roots, self.leaves, self.most = [], 0, 0  # most: points of the sample in the largest leaf
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, spill, rng))

    def _grow(self, x: np.ndarray, own: np.ndarray, leaf: int, spill: float, rng: np.random.Generator, depth: int = 0) -> int:
        if len(own) > leaf and depth < 40 and not _dense(x, own, rng):
            for _ in range(4):
                i, j = rng.choice(own, 2, replace=False)
                way = x[i] - x[j]
                if way @ way > 1e-12:
                    p = x[own] @ way
                    low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
                    left, right = own[p <= high], own[p >= low]
                    if max(len(left), len(right)) < 0.95 * len(own):
                        at = len(self.splits)
                        self.splits.append((way, low, high, 0, 0))
                        kids = [self._grow(x, o, leaf, spill, rng, depth + 1) for o in (left, right)]
                        self.splits[at] = (way, low, high, *kids)
                        return at
        self.leaves += 1
        self.most = max(self.most, len(own))
        return -self.leaves

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every place that rows have in the forest; leaves from 0."""
        rows, at = [], []
        todo = [(r, np.arange(len(x))) for r in self.roots]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                at.append(np.full(len(own), -node - 1, np.int32))
            else:
                way, low, high, a, b = self.splits[node]
                p = x[own] @ way
                todo += [(a, own[p <= high]), (b, own[p >= low])]
        return np.concatenate(rows), np.concatenate(at)


def compare(x: np.ndarray, times: np.ndarray, size: np.ndarray, leaves: list[np.ndarray], here: int, least: float, group: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the nodes of one leaf: links of each that this leaf counts, and the edges of a spanning forest; group: only pairs of
    different groups are compared."""
    links, union, edges = np.zeros(len(x), np.int64), Union(len(x)), []
    most = max(len(v) for v in leaves)
    lists = np.full((len(x), most), -1, np.int64)
    for i, v in enumerate(leaves):
        lists[i, : len(v)] = v
    lower = np.where(lists < here, lists, -1)  # leaves before this one
    other = np.where(lower < 0, -2, lower)
    for a in range(0, len(x), BLOCK):
        for b in range(a, len(x), BLOCK):
            i, j = np.nonzero(x[a : a + BLOCK] @ x[b : b + BLOCK].T >= least)
            i, j = i + a, j + b
            on = (i < j) & (size[i] == size[j])
            if group is not None:
                on &= group[i] != group[j]
            i, j = i[on], j[on]
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                new = np.ones(len(p), bool)
                for c in range(most):
                    new &= ~(lower[p, c, None] == other[q]).any(1)
                links += np.bincount(p[new], weights=times[q[new]], minlength=len(x)).astype(np.int64)
                links += np.bincount(q[new], weights=times[p[new]], minlength=len(x)).astype(np.int64)
            for p, q in zip(i.tolist(), j.tolist()):
                if union.find(p) != union.find(q):
                    union.join(p, q)
                    edges.append((p, q))
    return links, edges


def unit(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, filled up with zeros to `width`, and their numbers of components."""
    at = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(at)), at), np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True)), at


def refined(nodes: DataFrame, forest: Forest, n: int, width: int, leaf: int, sample: int, wide: int) -> DataFrame:
    """(node, leaves, groups): the leaves of every node, those that hold more than 4 * leaf nodes split again, each by a sample of at most about
    `sample` of its own; groups: into how many a leaf that cannot be split is dealt."""
    held = nodes.sparkSession.sparkContext.broadcast(forest)
    placed = pa.schema([("node", pa.int64()), ("leaf", pa.int64()), ("last", pa.bool_())])

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, 1 << 20):
            row, at = held.value.leaves_of(unit(t["embedding"].combine_chunks(), width)[0])
            yield pa.RecordBatch.from_arrays([pa.array(t["node"].to_numpy()[row]), pa.array(at.astype(np.int64)), pa.array(np.zeros(len(at), bool))], schema=placed)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, kept = None, None, []
        for b in batches:
            leaves, kinds = b.column("leaf").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((leaves[1:] != leaves[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if a == z:
                    continue
                if leaves[a] != now:
                    now, tree, kept = leaves[a], None, []
                part = b.slice(a, z - a)
                x, _ = unit(part.column("embedding"), width)
                if kinds[a] == 0:  # the leaf's sample comes first
                    kept.append(x)
                    continue
                if tree is None:
                    own = np.concatenate(kept) if kept else np.zeros((0, width))
                    tree = Forest(own, max(6, leaf * len(own) // int(part.column("size")[0].as_py())), 1, seed=int(now) & 0xFFFFFFFF)
                row, at = tree.leaves_of(x)
                new = C.mix(at.astype(np.uint64) + np.uint64(1) + np.uint64(now) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)
                last = tree.leaves == 1
                at = np.full(len(row), now) if last else new.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("node").to_numpy()[row]), pa.array(at), pa.array(np.full(len(row), last))], schema=placed)

    sql = "node long, leaf long, last boolean"
    now, done = C.materialise(nodes.mapInArrow(assigned, sql), "embedding-leaves"), []
    for _ in range(ROUNDS):
        big = C.materialise(now.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > 4 * leaf), "embedding-large")
        if big.isEmpty():
            break
        done.append(now.join(big, "leaf", "left_anti").select("node", "leaf"))
        inside = now.join(big, "leaf").join(nodes.select("node", "embedding"), "node").select("leaf", "size", "node", "embedding")
        some = inside.where(F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 20)) * F.col("size") < F.lit(sample << 20))
        rows = inside.withColumn("kind", F.lit(1)).unionAll(some.withColumn("kind", F.lit(0)))
        new = C.materialise(C.exchange(rows, n, "leaf", "kind").mapInArrow(split, sql), "embedding-leaves")
        done.append(new.where("last").select("node", "leaf"))
        now = new.where(~F.col("last"))
    whole = now.select("node", "leaf")
    for x in done:
        whole = whole.unionAll(x)
    whole = C.materialise(whole, "embedding-leaves")
    groups = whole.groupBy("leaf").agg(F.ceil(F.count("*") / wide).cast("int").alias("groups")).where("groups > 1")
    each = whole.join(groups, "leaf", "left").select("node", F.struct("leaf", F.coalesce("groups", F.lit(1)).alias("groups")).alias("x"))
    lists = each.groupBy("node").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return lists.select("node", F.col("x.leaf").alias("leaves"), F.col("x.groups").alias("groups"))


def near_vectors(vectors: DataFrame, least: float = 0.9, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, wide: int = WIDE) -> DataFrame:
    """vectors (vec_id, embedding): vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    n = C.buckets_for(vectors, 1 << 20)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size("embedding") == 0) | ~F.exists("embedding", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~bad, F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("good", good)
    distinct = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"))
    nodes = C.materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "embedding-nodes")
    count, width = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    picked = nodes.orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").toPandas()["embedding"] if count else []  # `sample` rows
    if count:
        x, _ = unit(pa.array(list(picked), pa.list_(pa.float64())), width)
        forest = Forest(x, max(6, leaf * len(x) // count), trees or trees_for(count, leaf))
        routes = refined(nodes, forest, n, width, leaf, sample, wide) if forest.most * count > 4 * leaf * len(x) else None
    else:
        forest, routes = Forest(np.zeros((0, 1)), 1), None
    held = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE / 3 splits a tree
    sent = pa.schema([("leaf", pa.int64()), ("data", pa.binary())])

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, 1 << 20):
            vectors = t["embedding"].combine_chunks()
            node, times = t["node"].to_numpy(), t["times"].to_numpy()
            if "leaves" in t.column_names:
                known = t["leaves"].combine_chunks()
                bounds = np.concatenate([[0], np.cumsum(np.diff(known.offsets.to_numpy()))])
                lists, parts = known.flatten().to_numpy(), t["groups"].combine_chunks().flatten().to_numpy()
                row = np.repeat(np.arange(len(node)), np.diff(bounds))
                size = np.diff(vectors.offsets.to_numpy())
            else:
                x, size = unit(vectors, width)
                row, at = held.value.leaves_of(x)
                by = np.lexsort((at, row))
                row, lists = row[by], at[by].astype(np.int64)
                bounds, parts = np.searchsorted(row, np.arange(len(x) + 1)), np.ones(len(row), np.int32)
            # A leaf in g groups is one key for each pair of groups; its nodes go to those of their group.
            group = (C.mix(node.astype(np.uint64))[row] % parts.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(row)), parts)
            other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
            low, high, many = np.minimum(group[each], other), np.maximum(group[each], other), parts[each] > 1
            code = C.mix(C.mix(lists[each].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64)) + high.astype(np.uint64) + np.uint64(1))
            key = np.where(many, (code >> np.uint64(2)).astype(np.int64), lists[each])
            raw, raw_at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            by = np.argsort(key, kind="stable")
            first, k = C.runs_of(key[by])
            out = []
            for a, m in zip(first.tolist(), k.tolist()):
                pick = each[by[a : a + m]]
                own = row[pick]
                cross = by[a] < len(low) and bool(low[by[a]] != high[by[a]]) and bool(many[by[a]])
                out.append((int(key[by[a]]), C.pack_arrays(node[own], times[own], size[own].astype(np.int32), np.concatenate([raw[raw_at[i] : raw_at[i + 1]] for i in own]), np.diff(bounds)[own].astype(np.int32), np.concatenate([lists[bounds[i] : bounds[i + 1]] for i in own]), np.array([lists[pick[0]]]), group[pick] if cross else np.full(m, -1))))
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, g.type) for c, g in zip(zip(*out[i : i + 256]), sent)], schema=sent)

    found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in C.by_key(batches, "leaf"):
            got = [x for b in batch for x in C.blobs(b.column("data"))]
            node, times, size, raw, k, flat, here, group = (np.concatenate([x[i] for x in got]) for i in range(8))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(raw))
            x, _ = unit(lists, width)
            links, edges = compare(x, times, size, np.split(flat, np.cumsum(k)[:-1]), int(here[0]), least, group if group[0] >= 0 else None)
            some = np.flatnonzero(links)
            cols = [np.concatenate([node[some], node[[e[0] for e in edges]]]), pa.array([None] * len(some) + node[[e[1] for e in edges]].tolist(), pa.int64()), np.concatenate([links[some], np.zeros(len(edges), np.int64)])]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), cols[1], pa.array(cols[2])], schema=found)

    sources = nodes.join(routes, "node") if routes is not None else nodes
    out = C.materialise(C.exchange(sources.mapInArrow(routed, "leaf long, data binary"), n, "leaf").mapInArrow(compared, "a long, b long, links long"), "embedding-links")
    links = out.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(out.where("b is not null").select("a", "b"), "embedding-components")
    known = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    joined = rows.where("good").join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return joined.unionAll(rest).toDF("vec_id", "n_links", "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
