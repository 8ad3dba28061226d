"""Operator 9: n-gram Jaccard join with multiple global orders, and the components of its links.

Sets are the distinct 4-word shingles (64-bit hashes) of lower-cased texts; equal sets are one node, whatever their copies.  If two
sets link, then under every global order of the shingles the first n - ceil(t*n) + 1 of each (its prefix) share a shingle.
1. Document frequencies of all shingles are counted (packed exchange); frequent ones go last in every order.  Only the most
   frequent FREQUENT of them are told apart, which changes how selective an order is, never what is found.
2. Texts are dealt by their least shingle under a random order, so most near copies meet; frequent least shingles are salted.
   Each task verifies star pairs there and joins them to clusters.  This only finds true links early.
3. Clusters send the prefixes of their members under ORDERS orders.  Clusters that share a prefix shingle under every order are
   candidates: the filters of the orders are intersected.  A shared shingle counts if what is left of both sets from its place in
   their prefixes on could still reach the similarity.
4. Candidates are verified, first leader against leader, then, where that leaves two clusters apart, all members against all.
5. Components of the verified links.

Defined results: null, empty or white-space text has an empty set and its own component; rows of one doc_id and different texts
are one document with several sets (each row has its own n_shingles); a null doc_id links with nothing and has a null component;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C
from quadrille.llm.graph import components

U64 = np.uint64
ORDERS = 3
COMMON = 16  # documents from which a shingle counts as frequent
FREQUENT = 1 << 20  # how many frequent shingles are told apart by frequency: bounds the broadcast to 12 MB
SALTED = 256  # texts that share a least shingle and stay together
STARS = 4  # rounds of star pairs
FEW = 100_000  # wanted texts that are broadcast by number: 3 MB
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)
_LOW48 = U64((1 << 48) - 1)
_SENT = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
_SENT_SQL = "bucket long, data binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def sets_of(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their offsets."""
    data, at = C.text_bytes(column)
    return C.distinct_per_text(*C.shingles(C.lower_ascii(data), at, n))


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each set; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(C.mix(values ^ _SEEDS[7]), dtype=U64)])
    size = np.diff(at).astype(U64)
    return np.where(size > 0, C.mix(total[at[1:]] - total[at[:-1]] + size) | U64(1), U64(0))


def least(values: np.ndarray, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Least hash of each set under a random order (the largest number for empty sets)."""
    h = C.mix(values ^ seed)
    out = np.full(len(at) - 1, np.iinfo(np.uint64).max, U64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(h, at[full])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def frequent_shingles(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bucket, low 32 bits) of the most frequent shingles, sorted, and their document frequencies; at most FREQUENT.

    Every shingle of every text is counted.  A code may stand for more than one shingle; it is used for ordering alone."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            v, _ = sets_of(t["text"], shingle)
            v.sort()
            first, count = C.runs_of(v)
            v = v[first]
            at = np.searchsorted(C.bucket_of(v, n), np.arange(n + 1))
            rows = []
            for b, (x, y) in enumerate(zip(at[:-1], at[1:])):
                if x < y:
                    more = np.flatnonzero(count[x:y] > 1)
                    rows.append((b, C.pack_arrays(v[x:y].astype(np.uint32), more.astype(np.uint32), count[x:y][more].astype(np.uint32))))
            yield _batch(rows, _SENT)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in C.by_key(batches, "bucket"):
            codes, counts = [], []
            for b in held:
                for v, more, count in C.blobs(b.column("data")):
                    k = np.ones(len(v), np.uint32)
                    k[more] = count
                    codes.append(v)
                    counts.append(k)
            codes, counts = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            first, _ = C.runs_of(codes)
            total = np.add.reduceat(counts, first)
            keep = np.flatnonzero(total >= COMMON)
            keep = keep[np.argsort(-total[keep], kind="stable")[: max(1, FREQUENT // n)]]
            yield _batch([(bucket, C.pack_arrays(codes[first[keep]], total[keep].astype(np.uint32)))], _SENT)

    got = C.exchange(docs.select("text").mapInArrow(told, _SENT_SQL), n, "bucket").mapInArrow(summed, _SENT_SQL).collect()  # FREQUENT entries at most
    codes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for r in got:
        v, k = C.unpack_arrays(bytes(r.data))
        codes.append(v.astype(U64) | U64(r.bucket << 32))
        counts.append(k.astype(np.int64))
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes)
    return codes[order], counts[order]


def frequency(v: np.ndarray, n: int, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequency of those told apart, else 0."""
    if not len(codes):
        return np.zeros(len(v), np.int64)
    code = (v & U64(0xFFFFFFFF)) | (C.bucket_of(v, n).astype(U64) << U64(32))
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[at] == code, counts[at], 0)


def prefixes(v: np.ndarray, at: np.ndarray, freq: np.ndarray, seed: np.uint64, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the prefix shingles of each set under one order (rare first, then random), in order, and their offsets."""
    rank = (np.minimum(freq, (1 << 20) - 1).astype(U64) << U64(44)) | (C.mix(v ^ seed) >> U64(20))
    size = np.diff(at)
    take = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
    out = []
    for a, z, k in zip(at[:-1].tolist(), at[1:].tolist(), take.tolist()):
        own = rank[a:z]
        pick = np.argpartition(own, k - 1)[:k] if k < z - a else np.arange(z - a)
        out.append(pick[np.argsort(own[pick])] + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(take)])


def _pairs(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of each list, a bounded number at a time."""
    for m in np.unique(size):
        at = first[size == m]
        if m <= 64:
            i, j = np.triu_indices(int(m), 1)
            for x in range(0, len(at), max(1, 1_000_000 // len(i))):
                p = at[x : x + max(1, 1_000_000 // len(i))]
                yield (p[:, None] + i).ravel(), (p[:, None] + j).ravel()
        else:
            for a in at:
                for i in range(int(m) - 1):
                    yield np.full(m - 1 - i, a + i), np.arange(a + i + 1, a + m)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def join_nodes(docs: DataFrame, shingle: int = 4, percent: int = 85, stars: int = STARS, salted: int = SALTED) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, leader) of all documents, and candidate leader pairs (a, b) by the low 48 bits of their
    nodes; clusters of one leader are linked already."""
    spark = docs.sparkSession
    C.small_batches(spark)
    n = C.buckets_for(docs)
    codes, counts = frequent_shingles(docs, n, shingle)
    frequent = spark.sparkContext.broadcast((codes, counts))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = frequent.value
        for t in C.chunks(batches, C.CHUNK_BYTES // 2):
            data, at = C.text_bytes(t["text"])
            v, at = C.shingles(C.lower_ascii(data), at, shingle)
            h = C.mix(v ^ _SEEDS[0])
            key = np.zeros(t.num_rows, U64)
            full = np.flatnonzero(np.diff(at) > 0)
            salts = np.ones(t.num_rows, np.int64)
            if len(full):
                key[full] = np.minimum.reduceat(h, at[full])
                owner = np.repeat(np.arange(t.num_rows), np.diff(at))
                lowest = np.flatnonzero(h == key[owner])
                salts[owner[lowest]] = 1 + frequency(v[lowest], n, codes, counts) // salted
            empty = np.diff(at) == 0
            mixed = C.mix(np.arange(t.num_rows, dtype=U64) + U64(len(v)))
            key = np.where(empty, mixed, C.mix(key) + mixed % salts.astype(U64))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(key.astype(np.int64)), t["text"].combine_chunks()], ["doc_id", "place", "text"])

    def clustered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = frequent.value
        for t in C.whole_keys(batches, "place"):
            v, at = sets_of(t["text"], shingle)
            size, node = np.diff(at), set_hash(v, at)
            # One row for each node; it stands for its copies.
            _, rep, back = np.unique(node, return_index=True, return_inverse=True)
            rep = rep.astype(np.int64)
            k = size[rep]
            new_at = np.concatenate([[0], np.cumsum(k)])
            v = v[np.arange(new_at[-1]) + np.repeat(at[rep] - new_at[:-1], k)]
            own = node[rep]
            sets = [v[a:z] for a, z in zip(new_at[:-1].tolist(), new_at[1:].tolist())]
            union = Union(len(rep))
            full = np.flatnonzero(k > 0)
            freq = frequency(v, n, codes, counts)
            rare = np.bincount(np.repeat(np.arange(len(rep)), k), weights=freq == 0, minlength=len(rep))
            full = full[np.argsort(rare[full], kind="stable")]  # centres of stars: those with the fewest shingles of their own
            for j in range(stars):
                low = least(v, new_at, _SEEDS[j])[full]
                by = np.argsort(low, kind="stable")
                first, many = C.runs_of(low[by])
                for a, m in zip(first[many > 1].tolist(), many[many > 1].tolist()):
                    star = full[by[a : a + m]].tolist()
                    for x in star[1:]:
                        if union.find(x) != union.find(star[0]) and linked(sets[star[0]], sets[x], percent):
                            union.join(x, star[0])
            lead = own[np.array([union.find(i) for i in range(len(rep))], np.int64)]
            rows = [(-1 - int(t["place"][0].as_py() % n), C.pack_arrays(t["doc_id"].is_null().to_numpy(), t["doc_id"].fill_null(0).to_numpy().astype(np.int64), size.astype(np.int64), node, lead[back]))]
            for order in range(ORDERS):
                pos, pre_at = prefixes(v, new_at, freq, _SEEDS[4 + order % 3] + U64(order // 3), percent)
                per = np.diff(pre_at)
                token, label, n_own = v[pos], np.repeat(lead & _LOW48, per), np.repeat(k, per)
                left = n_own - (np.arange(len(pos)) - np.repeat(pre_at[:-1], per))  # shingles from here on
                by, bounds = C.split_by(C.bucket_of(token, n), n)
                token, label = token[by].astype(np.uint32), label[by]
                small = np.uint16 if k.max(initial=0) < 1 << 16 else np.uint32
                left, n_own = left[by].astype(small), n_own[by].astype(small)
                rows += [(order * n + b, C.pack_arrays(token[x:y], (label[x:y] & U64(0xFFFFFFFF)).astype(np.uint32), (label[x:y] >> U64(32)).astype(np.uint16), left[x:y], n_own[x:y])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if x < y]
            yield _batch(rows, _SENT)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in C.by_key(batches, "bucket"):
            if bucket < 0:
                yield from held
                continue
            got = [x for b in held for x in C.blobs(b.column("data"))]
            token = np.concatenate([x[0] for x in got])
            label = np.concatenate([x[1].astype(U64) | (x[2].astype(U64) << U64(32)) for x in got])
            left, n_own = (np.concatenate([x[i].astype(np.int64) for x in got]) for i in (3, 4))
            by = np.argsort(token)
            near = np.zeros(len(token), bool)
            near[1:] = token[by[1:]] == token[by[:-1]]
            near[:-1] |= near[1:]
            by = by[near]
            by = by[np.lexsort((label[by], token[by]))]
            token, label, left, n_own = token[by], label[by], left[by], n_own[by]
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            # Sets that share this shingle first share at most what is left of either: (100 + t) * left >= t * (n + other n).
            token, label, least_n = token[at], label[at], np.minimum.reduceat(n_own, at)
            most_n = np.maximum.reduceat(left, at) * (100 + percent) // percent - least_n
            first, size = C.runs_of(token)
            first, size = first[size > 1], size[size > 1]
            bit, held_a, held_b, total = 1 << (bucket // n), [], [], 0
            for i, j in _pairs(first, size):
                ok = (least_n[i] <= most_n[j]) & (least_n[j] <= most_n[i])
                held_a.append(label[i[ok]])
                held_b.append(label[j[ok]])
                total += int(ok.sum())
                if total > 2_000_000:
                    a, b = _distinct_pairs(np.concatenate(held_a), np.concatenate(held_b))
                    yield from _pair_rows(a, b, bit, n)
                    held_a, held_b, total = [], [], 0
            if total:
                a, b = _distinct_pairs(np.concatenate(held_a), np.concatenate(held_b))
                yield from _pair_rows(a, b, bit, n)

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        for bucket, held in C.by_key(batches, "bucket"):
            got = [x for b in held for x in C.blobs(b.column("data"))]
            if bucket < 0:
                for null, doc, size, node, lead in got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int32)), pa.array(doc, mask=null), pa.array(size), pa.array(node.astype(np.int64)), pa.array(lead.astype(np.int64))], schema=schema)
                continue
            a, b = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            bits = np.concatenate([x[2] for x in got])
            by = np.lexsort((b, a))
            a, b, bits = a[by], b[by], bits[by]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            every = np.bitwise_or.reduceat(bits, at) == (1 << ORDERS) - 1
            at = at[every]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), none, none, pa.array(a[at].astype(np.int64)), pa.array(b[at].astype(np.int64))], schema=schema)

    put = C.exchange(docs.select("doc_id", "text").mapInArrow(placed, "doc_id long, place long, text string"), n, "place")
    lists = C.exchange(put.mapInArrow(clustered, _SENT_SQL), n, "bucket").mapInArrow(listed, _SENT_SQL)
    both = C.materialise(C.exchange(lists, n, "bucket").mapInArrow(met, "kind int, doc_id long, n_shingles long, a long, b long"), "ngram-nodes")
    nodes = both.where("kind = 0").select("doc_id", "n_shingles", F.col("a").alias("node"), F.col("b").alias("leader"))
    return nodes, both.where("kind = 1").select("a", "b")


def _pair_rows(a: np.ndarray, b: np.ndarray, bit: int, n: int) -> Iterator[pa.RecordBatch]:
    by, bounds = C.split_by(C.bucket_of(C.mix(a ^ C.mix(b)), n), n)
    a, b = a[by], b[by]
    yield _batch([(i, C.pack_arrays(a[x:y], b[x:y], np.full(y - x, bit, np.uint8))) for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if x < y], _SENT)


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, shingle: int, percent: int, few: int = FEW) -> DataFrame:
    """Of pairs (a, b) of clusters those with a linked pair of members (cluster, node, doc_id: one document for each node)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.select("a", "b", F.col("a").alias("cluster")).unionAll(pairs.select("a", "b", F.col("b").alias("cluster")))
    wanted = C.materialise(members.join(sides.select("cluster").distinct(), "cluster", "left_semi"), "ngram-wanted")
    small = wanted.count() <= few  # spares a shuffle of all texts
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, "doc_id").select("cluster", "node", "text")
    rows = sides.join(texts, "cluster").select("a", "b", F.col("cluster") == F.col("a"), "node", "text").toDF("a", "b", "left", "node", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.whole_keys(batches, "pair", C.CHUNK_BYTES // 2):  # a cluster in many pairs does not hold them all at once
            v, at = sets_of(t["text"], shingle)
            right = set_hash(v, at).astype(np.int64) == t["node"].to_numpy()  # a doc_id may have other texts too
            a, b, left = t["a"].to_numpy(), t["b"].to_numpy(), t["left"].to_numpy()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            found = []
            for x, z in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows]):
                i, j = ((x + np.flatnonzero(right[x:z] & (left[x:z] == side))).tolist() for side in (True, False))
                if any(linked(v[at[e] : at[e + 1]], v[at[f] : at[f + 1]], percent) for e in i for f in j):
                    found.append((int(a[x]), int(b[x])))
            if found:
                yield _batch(found, schema)

    return rows.withColumn("pair", F.xxhash64("a", "b")).repartition(n, "pair").sortWithinPartitions("pair", "a", "b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 85, stars: int = STARS, salted: int = SALTED, few: int = FEW) -> DataFrame:
    """Rows of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links reach).  stars, salted and few change how
    links are found, never which: without stars all come from the filters of the orders."""
    nodes, candidates = join_nodes(docs, shingle, percent, stars, salted)
    full = nodes.where("n_shingles > 0 and doc_id is not null")
    # A node may have been placed with several leaders (salts); they are one component from the start.
    same = full.groupBy("node").agg(F.min("leader").alias("x"), F.max("leader").alias("y"))
    several = full.join(same.where("x <> y").select("node", "x"), "node").select(F.col("leader").alias("a"), F.col("x").alias("b")).distinct()
    low = F.col("leader").bitwiseAND((1 << 48) - 1)
    heads = full.select("leader").distinct().select("leader", low.alias("low"))
    pairs = candidates.join(heads.toDF("a1", "a"), "a").join(heads.toDF("b1", "b"), "b").select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")).where("a <> b").distinct()
    pairs = C.materialise(pairs, "ngram-pairs")
    members = full.groupBy(F.col("leader").alias("cluster"), "node").agg(F.min("doc_id").alias("doc_id"))
    links = several
    if not pairs.isEmpty():
        heads_only = members.where("cluster = node")
        first = C.materialise(verified(pairs, heads_only, docs, shingle, percent, few), "ngram-links")
        links = links.unionAll(first)
        comp = components(links, "ngram-components")
        label = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        # Where both clusters are their leaders alone, all has been said.
        size = members.groupBy("cluster").agg((F.count("*") > 1).alias("many"))
        pairs = pairs.join(size.toDF("a", "many_a"), "a").join(size.toDF("b", "many_b"), "b").where("many_a or many_b")
        rest = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")
        rest = C.materialise(rest, "ngram-rest")
        if not rest.isEmpty():
            links = links.unionAll(C.materialise(verified(rest, members, docs, shingle, percent, few), "ngram-links"))
    # Rows of one doc_id are one document.
    twice = full.groupBy("doc_id").agg(F.min("leader").alias("x"), F.max("leader").alias("y")).where("x <> y").select("doc_id", "x")
    links = links.unionAll(full.join(twice, "doc_id").select(F.col("leader").alias("a"), F.col("x").alias("b")).distinct())
    comp = components(links, "ngram-components")
    rooted = full.join(comp.toDF("leader", "root"), "leader", "left").select("doc_id", "leader", F.coalesce("root", "leader").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = rooted.select("leader", "root").distinct().join(smallest, "root").select("leader", "component_id")
    joined = nodes.join(of, "leader", "left")
    solo = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", solo.alias("component_id"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""


def components_by_definition(texts: dict[int, str | None], shingle: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """The contract read literally, for tests: all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    ids = sorted(sets)
    where = {d: i for i, d in enumerate(ids)}
    union, by = Union(len(ids)), {}
    for d in ids:
        near: dict[int, int] = {}
        for g in sets[d]:
            for other in by.setdefault(g, []):
                near[other] = near.get(other, 0) + 1
            by[g].append(d)
        for other, both in near.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[other]) - both):
                union.join(where[d], where[other])
    return {d: (len(sets[d]), ids[union.find(where[d])]) for d in ids}
