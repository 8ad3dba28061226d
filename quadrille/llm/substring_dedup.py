"""Operator 5: substring dedup by Rabin-Karp hashes of every 20-word window.

1. Each task hashes every window of its texts with a rolling polynomial over 64-bit word hashes.  Windows that repeat within the
   task's chunk keep their first occurrence; the others are removals at once, so a passage that a third of all texts share is sent
   once for each chunk.
2. First occurrences go to buckets of the hash (packed exchange) and are counted: where a hash occurs more than once, all but the
   earliest (doc_id, then start) are removals.
3. Removals go back to the texts.  Windows that start earlier elsewhere cover words; neighbouring windows merge to maximal
   intervals, and the words in them are removed.

What is compared grows with the input: seven bytes of a window's hash with its bucket, and as many bytes of a second, independent
hash as keep the expected number of wrong matches in the whole table below 1/16 (`second_bytes`: none at 0.5 GB, one at 30 GB, four at
100 TB).

Defined results: null or white-space text has no words; rows of one doc_id and equal text are one document given several times and
get one result; rows of one doc_id and different texts are different documents, ordered by a hash of their texts; a null doc_id
comes after all others; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quadrille.llm import common as C

WINDOW = 20
_NONE = (1 << 63) - 1
_SECOND = 0x9E6C63D0876A9A35  # seed of the second hash
_SENT = pa.schema([("bucket", pa.int32()), ("to", pa.int32()), ("data", pa.binary())])
_SENT_SQL = "bucket int, to int, data binary"


def _removals(ids: np.ndarray, th: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """Runs of removed windows, packed for each partition of the texts: (id, hash of the text, runs) and the runs."""
    part = np.mod(th ^ ids, n)
    order = np.lexsort((starts, th, ids, part))
    part, ids, th, starts, lengths = part[order], ids[order], th[order], starts[order], lengths[order]
    at, size = C.runs_of(part)
    for a, k in zip(at, size):
        i, t = ids[a : a + k], th[a : a + k]
        first = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (t[1:] != t[:-1])) + 1])
        yield int(part[a]), C.pack_arrays(i[first], t[first], np.diff(np.concatenate([first, [k]])).astype(np.uint32), starts[a : a + k].astype(np.uint32), lengths[a : a + k].astype(np.uint32))


def second_bytes(size: int, n: int) -> int:
    """Bytes of the second hash for a table of `size` bytes in n buckets.  w windows, at most one for two bytes, make w^2 / 2 pairs;
    seven bytes and the bucket (which knows the top of the eighth) tell 56 + min(8, log2 n) bits of the first hash."""
    bits = 2 * math.log2(max(size // 2, 2)) - 1 + 4
    return min(8, max(0, math.ceil((bits - 56 - min(8.0, math.log2(n))) / 8)))


def _low(h: np.ndarray, k: int = 7) -> np.ndarray:
    """The low k bytes of each hash: a bucket shares most of the eighth."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].ravel()


def _whole(b: np.ndarray, k: int = 7) -> np.ndarray:
    out = np.zeros((len(b) // k, 8), np.uint8)
    out[:, :k] = b.reshape(-1, k)
    return out.view("<u8").ravel()


def _sorted(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes (and equal second ones) together, early ones first, and whether each equals its predecessor."""
    by = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    same = np.zeros(len(h), bool)
    same[1:] = h[by[1:]] == h[by[:-1]]
    if g is not None:
        same[1:] &= g[by[1:]] == g[by[:-1]]
    return by, same


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, into: str = "dedup", more: int | None = None) -> DataFrame:
    """docs (doc_id, text and any other columns) with: kept (text without the removed words), kept_words (those left, joined by
    one space), n_words, n_removed, removed (maximal intervals of word positions, end excluded); all in a struct column `into`,
    which replaces an input column of that name.  more: bytes of the second hash, by the table's size if not given."""
    spark = docs.sparkSession
    C.small_batches(spark)
    size = C.size_of(docs.select("text"))
    n = C.buckets_for(docs, size=size)
    more = second_bytes(size, n) if more is None else more
    but = ("doc_id", "text", into.lower())
    rest = [c for c in docs.columns if c.lower() not in but]
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", key.alias("th"), F.struct(*C.own(docs, but)).alias("rest") if rest else F.lit(None).cast("int").alias("rest"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            ids = t["doc_id"].fill_null(_NONE).to_numpy().astype(np.int64)
            th = t["th"].to_numpy().astype(np.int64)
            order = np.lexsort((th, ids))
            new = np.ones(len(order), bool)
            new[1:] = (ids[order][1:] != ids[order][:-1]) | (th[order][1:] != th[order][:-1])
            order = order[new]
            ids, th = ids[order], th[order]
            data, at = C.text_bytes(t["text"].take(pa.array(order)))
            first, last, words_at = C.word_spans(data, at)
            h = C.word_hashes(data, first, last)
            pos, win_at = C.windows_of(words_at, window)
            if not len(pos):
                continue
            h = C.rolling(h, window)[pos]
            g = C.rolling(C.word_hashes(data, first, last, _SECOND), window)[pos] if more else None
            owner = np.repeat(np.arange(len(ids)), np.diff(win_at))
            start = pos - words_at[owner]
            by, same = _sorted(h, g)
            again = np.zeros(len(h), bool)
            again[by] = same
            out: list[tuple] = []
            gone = np.flatnonzero(again)
            if len(gone):  # neighbouring windows of a text as one run
                cut = np.ones(len(gone), bool)
                cut[1:] = (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])
                a = gone[cut]
                k = np.diff(np.concatenate([np.flatnonzero(cut), [len(gone)]]))
                out += [(p % n, p, d) for p, d in _removals(ids[owner[a]], th[owner[a]], start[a], k, n)]
            live = np.flatnonzero(~again)
            by, bounds = C.split_by(C.bucket_of(h[live], n), n)
            for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                if x < y:
                    i = live[by[x:y]]
                    f, k = C.runs_of(owner[i])
                    d = owner[i][f]
                    out.append((b, -1, C.pack_arrays(ids[d], th[d], k.astype(np.uint32), start[i].astype(np.uint16 if start.max() < 1 << 16 else np.uint32), _low(h[i]), *([_low(g[i], more)] if more else []))))
            yield _sent(out)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in C.by_key(batches, "bucket"):
            t = pa.Table.from_batches(held)
            to = t["to"].to_numpy()
            passed = t.filter(pa.array(to >= 0))
            if passed.num_rows:
                yield from (b.select(["bucket", "to", "data"]) for b in passed.to_batches())
            got = [x for c in t.filter(pa.array(to < 0))["data"].chunks for x in C.blobs(c)]
            if not got:
                continue
            h = np.concatenate([_whole(x[4]) for x in got])
            g = np.concatenate([_whole(x[5], more) for x in got]) if more else None
            by, same = _sorted(h, g)
            many = np.zeros(len(h), bool)
            many[by[same]] = True
            many[by[:-1][same[1:]]] = True
            if more:  # a number for each pair of hashes
                h[by] = np.cumsum(~same).astype(h.dtype)
            sub = np.flatnonzero(many)
            if not len(sub):
                continue
            runs = np.concatenate([x[2] for x in got]).astype(np.int64)
            doc = np.repeat(np.arange(len(runs)), runs)[sub]
            ids = np.concatenate([x[0] for x in got])[doc]
            th = np.concatenate([x[1] for x in got])[doc]
            start = np.concatenate([x[3].astype(np.uint32) for x in got])[sub]
            h = h[sub]
            by = np.lexsort((start, th, ids, h))
            ids, th, start, h = ids[by], th[by], start[by], h[by]
            f, k = C.runs_of(h)
            lead = np.repeat(f, k)
            gone = np.flatnonzero((ids != ids[lead]) | (th != th[lead]) | (start != start[lead]))
            rows = [(bucket, p, d) for p, d in _removals(ids[gone], th[gone], start[gone], np.ones(len(gone), np.uint32), n)]
            if rows:
                yield _sent(rows)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _runs(batches):
            where: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            for b in held:
                kind = b.column("kind").to_numpy()
                k = int((kind == 0).sum())
                if k:
                    for ids, th, count, start, length in C.blobs(b.column("data").slice(0, k)):
                        z = np.cumsum(count)
                        for i, t, a, e in zip(ids.tolist(), th.tolist(), (z - count).tolist(), z.tolist()):
                            where.setdefault((i, t), []).append((start[a:e], length[a:e]))
                if k < b.num_rows:
                    yield _cut_batch(b.slice(k), where, window)

    sent = keyed.select("doc_id", "text", "th").mapInArrow(hashed, _SENT_SQL)
    back = C.exchange(sent, n, "bucket").mapInArrow(counted, _SENT_SQL)
    part = F.pmod(F.col("th").bitwiseXOR(F.coalesce("doc_id", F.lit(_NONE))), F.lit(n))
    # Texts too short for a window lose nothing, so they go anywhere: null or empty ones may be a third of all rows.
    part = F.when(F.length(F.coalesce("text", F.lit(""))) < 2 * window - 1, F.pmod(F.monotonically_increasing_id(), F.lit(n))).otherwise(part).cast("int")
    rest_type = keyed.schema["rest"].dataType
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("th"), F.lit(None).cast(rest_type).alias("rest")]
    both = back.select(F.col("to").alias("part"), F.lit(0).alias("kind"), "data", *none).unionAll(keyed.select(part, F.lit(1), F.lit(None).cast("binary"), "doc_id", "text", "th", "rest"))
    interval = ArrayType(StructType([StructField("from", IntegerType()), StructField("to", IntegerType())]))
    added = StructType([StructField("kept", StringType()), StructField("kept_words", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", interval)])
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rest", rest_type), StructField("dedup", added)])
    out = C.exchange(both, n, "part", "kind").mapInArrow(cut, schema)
    return out.select("doc_id", "text", *[F.col("rest").getField(c).alias(c) for c in rest], F.col("dedup").alias(into))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches of one partition number after the other, each as it comes; unlike by_key nothing is held."""
    it = iter(batches)
    rest: list[pa.RecordBatch] = []

    def of(now: int) -> Iterator[pa.RecordBatch]:
        while True:
            b = rest.pop() if rest else next(it, None)
            if b is None:
                return
            k = b.column("part").to_numpy()
            same = int(np.searchsorted(k, now, "right"))
            if same:
                yield b.slice(0, same)
            if same < len(k):
                rest.append(b.slice(same))
                return

    while True:
        b = rest.pop() if rest else next(it, None)
        if b is None:
            return
        if not b.num_rows:
            continue
        rest.append(b)
        now = b.column("part")[0].as_py()
        part = of(now)
        yield now, part
        for _ in part:  # what the caller left
            pass


_INTERVAL = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _cut_batch(b: pa.RecordBatch, where: dict, window: int) -> pa.RecordBatch:
    data, at = C.text_bytes(b.column("text"))
    first, _, words_at = C.word_spans(data, at)
    ids = b.column("doc_id").fill_null(_NONE).to_pylist()
    kept, plain, n_removed, intervals = [], [], [], []
    for j, (key, text) in enumerate(zip(zip(ids, b.column("th").to_pylist()), b.column("text").to_pylist())):
        runs = where.get(key)
        raw = (text or "").encode()
        words = raw.split()
        if not runs:
            kept.append(text)
            plain.append(b" ".join(words))
            n_removed.append(0)
            intervals.append([])
            continue
        step = np.zeros(len(words) + 1, np.int64)
        for start, length in runs:
            np.add.at(step, start, 1)
            np.add.at(step, np.minimum(start.astype(np.int64) + length + window - 1, len(words)), -1)
        stay = np.cumsum(step)[:-1] == 0
        n_removed.append(int(len(words) - stay.sum()))
        plain.append(b" ".join(compress(words, stay.tolist())))
        edge = np.flatnonzero(np.diff(np.concatenate([[1], stay, [1]]).astype(np.int8)))
        intervals.append([{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2])])
        byte_at = np.append(first[words_at[j] : words_at[j + 1]] - at[j], len(raw))
        pieces, last = [], 0
        for x, y in zip(edge[::2], edge[1::2]):
            pieces.append(raw[last : byte_at[x]])
            last = byte_at[y]
        kept.append(b"".join([*pieces, raw[last:]]).decode())
    dedup = pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array([x.decode() for x in plain], pa.string()), pa.array(np.diff(words_at), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(intervals, _INTERVAL)], ["kept", "kept_words", "n_words", "n_removed", "removed"])
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("rest"), dedup], ["doc_id", "text", "rest", "dedup"])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.documents(spark, sf_dir))
    return out.select("doc_id", F.col("dedup.n_words").alias("n_words"), F.col("dedup.n_removed").alias("n_removed"), F.sha2(F.col("dedup.kept_words").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) t(j) WHERE r > 1),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM e ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def removed_by_definition(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract read literally, for tests."""
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    seen: set[tuple] = set()
    out = {}
    for d in sorted(words):
        w, cover = words[d], [False] * len(words[d])
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                cover[i : i + window] = [True] * window
            seen.add(x)
        left = b" ".join(x for x, c in zip(w, cover) if not c)
        out[d] = (len(w), sum(cover), hashlib.sha256(left).hexdigest())
    return out
