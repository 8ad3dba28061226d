"""Operator 10: packing into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; rests are cut to pieces of at most PIECE ids.  Pieces of about
BATCH_WINDOWS windows form a batch, and multiway differencing deals the batch to windows: each piece starts as a partition of its
own, and the two partitions with the largest imbalance merge with opposing order, fullest window upon emptiest, until one is left.
Sums then lie within a few ids of each other; if the fullest still exceeds the capacity, the batch is dealt to one window more.
A batch is filled up to a few ids below capacity for each window, so almost nothing is padding.  A task packs what it reads, so
nothing is shuffled; sequence ids hold the partition in their high bits.

Defined results: null or empty text is the end id alone; repeated doc_ids are packed row by row; null doc_ids stay null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm import common as C
from quadrille.llm.wordbpe import encoder

PIECE = 512
BATCH_WINDOWS = 96
SLACK = 6


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k groups by the largest differencing method; returns the items' indices of each group."""
    left: list[int] = []
    right: list[int] = []
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        node = np.full(k, -1, np.int64)
        node[0] = i
        heap.append((-s if k > 1 else 0, i, sums, node))
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        sums, other = s1 + s2[::-1], n2[::-1]
        node = np.where(n1 < 0, other, n1)
        both = np.flatnonzero((n1 >= 0) & (other >= 0))
        if len(both):
            node[both] = n + len(left) + np.arange(len(both))
            left += n1[both].tolist()
            right += other[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        sums -= sums[-1]  # only differences matter from here on
        heapq.heappush(heap, (-int(sums[0]), stamp, sums, node))
        stamp += 1
    groups = []
    for root in heap[0][3].tolist() if heap else []:
        items, todo = [], [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += (right[x - n], left[x - n])
        groups.append(items)
    return groups


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`: as few as hold the sum, one more as long as the fullest exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return [g for g in groups if g]
        k += 1


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row for each piece of (doc_id, text): where it lies in its document and in which sequence; with_ids adds its ids."""
    C.small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)
    full = BATCH_WINDOWS * (capacity - SLACK)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        seq = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # doc_id, start, length, ids, doc_tokens
        total = 0
        out: list[tuple] = []

        def place(piece: tuple, offset: int) -> None:
            out.append((*piece[:3], C.crc(piece[3]), piece[4], seq, offset, *([piece[3].astype(np.int32)] if with_ids else [])))

        def deal() -> None:
            nonlocal held, total, seq
            for group in balanced([p[2] for p in held], capacity):
                offset = 0
                for i in sorted(group):
                    place(held[i], offset)
                    offset += held[i][2]
                seq += 1
            held, total = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out
            done, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(done, fields)], schema=schema)

        for b in batches:
            ids, at = enc.encode(b.column("text"), end)
            for doc, a, z in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                n, own, start = z - a, ids[a:z], 0
                while n - start >= capacity:
                    place((doc, start, capacity, own[start : start + capacity], n), 0)
                    seq += 1
                    start += capacity
                while start < n:
                    size = min(PIECE, n - start, full - total)
                    held.append((doc, start, size, own[start : start + size], n))
                    total += size
                    start += size
                    if total == full:
                        deal()
            if out:
                yield batch()
        if held:
            deal()
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=2)
