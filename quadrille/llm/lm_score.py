"""Operator 8: language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Model: words, pairs and triples of neighbours, of lower-cased texts with a begin and an end mark.  All training documents are counted
(packed exchange).  A count c is quantised to level 1 + floor(log2 c) and stored as the keys (n-gram, 1) ... (n-gram, level); probing
level after level until one is absent reads it back, and an n-gram counts as the mean of its level's range.  Every n-gram is
stored, those seen once too, at every size.  Each bucket of n-grams builds its own part of the filter, sized by its keys, so the
filter grows with the input.  A filter that grows cannot be broadcast: parts are probed where they lie.
P1(w) = (c(w) + 1) / (N + V + 1);  P2(w | v) = (c(v w) + a P1(w)) / (c(v) + a);  P3(w | u v) = (c(u v w) + b P2(w | v)) / (c(u v) + b),
with c(v w) <= c(v) and c(u v w) <= c(u v); a text's first token has P2.  The strengths a and b are those of GRID that make
all training tokens likeliest when each is left out of its own counts.  A token's counts are five levels, and a chunk has few different
fives: each pair of GRID is tried once for each of these, so one pass sums the likelihoods and keeps every text's score by every pair.

Texts are stored in chunks.  A chunk sends its distinct n-grams, with their counts in training, to their buckets: a frequent word is one
entry for each chunk, the marks none, since the number of training documents is their count.  A bucket sums, builds its part, probes it
and answers each chunk with a level for each n-gram and, for the base score, exact counts of words.  Answers meet the stored chunk
again, so every text is scored where all its counts are.  Words are told apart by 64 bits, pairs and triples by 40 bits within a bucket.

Defined results: null text is empty and holds the end alone; rows of one doc_id and equal text count one by one in training
and get the same score; a null doc_id is in training; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C

U64 = np.uint64
END = U64(0x2545F4914F6CDD1D)
BEGIN = U64(0x27D4EB2F165667C5)
LEVELS = 63  # of any count in a signed 64-bit number
HASHES = 3
BLOCK = 1 << 16  # keys that a filter stores or probes at once
BITS_PER_KEY = 10
CODE_BITS = 40  # of a pair or triple within its bucket
PIECE = 4 << 20  # bytes of a batch that a task hands on
CHUNK = 8 << 20  # bytes of text that a task holds at once: its hashes take some twenty times as much
MARK = 255  # in place of a level: the count of a mark
GRID = [(a, b) for a in (100.0, 400.0, 1600.0, 6400.0, 25600.0) for b in (0.5, 1.5, 4.0, 10.0, 25.0)]
_CHUNK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("docs", pa.int64())])
_CHUNK_SQL = "chunk long, bucket int, data binary, docs long"
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])
_ANSWER_SQL = "chunk long, bucket int, data binary, tokens long, words long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# ---------------------------------------------------------------- n-grams


def _sequences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of every text with the begin and the end mark, and their offsets."""
    data = C.lower_ascii(data)
    starts, ends, at = C.word_spans(data, at)
    new_at = at + 2 * np.arange(len(at))
    out = np.empty(new_at[-1], U64)
    inner = np.ones(len(out), bool)
    inner[new_at[:-1]] = inner[new_at[1:] - 1] = False
    out[new_at[:-1]], out[new_at[1:] - 1] = BEGIN, END
    out[inner] = C.word_hashes(data, starts, ends)
    return out, new_at


def _grams(seq: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of a text's words (marks have code 0), pairs and triples, each with the offsets of the texts."""
    step = U64(0x9FB21C651E98DF25)
    marks = np.concatenate([at[:-1], at[1:] - 1])
    one = C.mix(seq)
    one[marks] = 0
    pos, two_at = C.windows_of(at, 2)
    two = C.mix(seq[pos] * step + seq[pos + 1])
    pos, three_at = C.windows_of(at, 3)
    return [(one, at), (two, two_at), (C.mix((seq[pos] * step + seq[pos + 1]) * step + seq[pos + 2] + U64(3)), three_at)]


def _distinct(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes but 0 in order, and how often each is in training."""
    by = np.argsort(codes)
    by = by[np.searchsorted(codes[by], U64(1)) :]
    codes = codes[by]
    first, _ = C.runs_of(codes)
    return codes[first], np.add.reduceat(train[by].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _lookup(codes: np.ndarray, marks: tuple[int, ...], *values: np.ndarray) -> list[np.ndarray]:
    """Each code's values, given in order of the distinct codes but 0; code 0 has those of a mark."""
    by = np.argsort(codes)
    ordered = codes[by]
    skip = int(np.searchsorted(ordered, U64(1)))
    _, many = C.runs_of(ordered[skip:])
    rows, out = np.repeat(np.arange(len(many)), many), []
    for mark, v in zip(marks, values):
        each = np.empty(len(codes), v.dtype)
        each[by[:skip]], each[by[skip:]] = mark, v[rows]
        out.append(each)
    return out


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte each, and in full those that need more."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def _full(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _first_of(bucket: int, n: int) -> int:
    """The least code of a bucket."""
    return -(-(bucket << 32) // n) << 32


def _put(codes: np.ndarray, bucket: int, n: int, bits: int) -> np.ndarray:
    """A bucket's sorted codes as differences, byte plane by byte plane: of a pair or triple the first `bits` that tell a bucket's apart."""
    x = (codes - U64(_first_of(bucket, n))) >> U64(max(0, 64 - int(math.log2(n)) - bits))
    d = np.diff(x, prepend=U64(0)).astype("<u8")
    planes = max(1, -(-int(d.max(initial=0)).bit_length() // 8))
    return np.concatenate([np.array([planes], np.uint8), d.view(np.uint8).reshape(-1, 8)[:, :planes].T.ravel()])


def _get(data: np.ndarray) -> np.ndarray:
    planes = int(data[0])
    d = np.zeros(((len(data) - 1) // planes, 8), np.uint8)
    d[:, :planes] = data[1:].reshape(planes, -1).T
    return np.cumsum(d.view("<u8").ravel(), dtype=U64)


# ---------------------------------------------------------------- the filter


class CountFilter:
    """One part of the log-frequency Bloom filter: as many bits as its keys need."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits_per_key: int = BITS_PER_KEY):
        level = np.frexp(np.asarray(counts, np.float64))[1].astype(np.uint8)  # 1 + floor(log2 c)
        self.bits = max(64, int(level.sum(dtype=np.int64)) * bits_per_key)
        on = np.zeros(self.bits, bool)
        for a in range(0, len(codes), BLOCK):
            some, last = codes[a : a + BLOCK], level[a : a + BLOCK]
            for j in range(1, int(last.max(initial=0)) + 1):
                for at in self._places(some[last >= j], j):
                    on[at] = True
        self.data = np.packbits(on, bitorder="little")

    def _places(self, codes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        x = C.mix(codes + U64(level * 0xA24BAED4963EE407 & (1 << 64) - 1))
        step = (x >> U64(32)) | U64(1)
        for k in range(HASHES):
            yield (x + U64(k) * step) % U64(self.bits)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """The last level of each code that is there after all before it; 0 if not even the first is."""
        return np.concatenate([self._levels(codes[a : a + BLOCK]) for a in range(0, len(codes), BLOCK)] or [np.zeros(0, np.uint8)]).astype(np.int64)

    def _levels(self, codes: np.ndarray) -> np.ndarray:
        level, live = np.zeros(len(codes), np.uint8), np.arange(len(codes))
        for j in range(1, LEVELS + 1):
            there = np.ones(len(live), bool)
            for at in self._places(codes[live], j):
                there &= (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
            live = live[there]
            if not len(live):
                break
            level[live] = j
        return level

    @staticmethod
    def mean(level: np.ndarray) -> np.ndarray:
        """Estimated counts: the mean of the level's range 2**(level - 1) ... 2**level - 1."""
        return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5, 0.0)


# ---------------------------------------------------------------- chunks of texts, and what buckets of n-grams answer them


def chunks_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, train) -> a row for each chunk of texts: its number, bucket -1, the packed documents, and how many of
    them are in training."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, t in enumerate(C.chunks(batches, CHUNK // 2)):
            data, at = C.text_bytes(t["text"])
            ids, train = t["doc_id"].combine_chunks(), t["train"].to_numpy()
            own = C.pack_arrays(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), train, at, data)
            yield _batch([(part + k, -1, own, int(train.sum()))], _CHUNK)

    return C.materialise(docs.mapInArrow(packed, _CHUNK_SQL), "lm-texts")


def _pieces(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, data, ...) as batches of about PIECE bytes."""
    a = n = 0
    for i, r in enumerate(rows, 1):
        n += len(r[2])
        if n >= PIECE or i == len(rows):
            yield _batch(rows[a:i], schema)
            a, n = i, 0


def _asked(chunk: int, train: np.ndarray, text_at: np.ndarray, data: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct n-grams with their counts in training, a row for each bucket of n that has some."""
    kinds = [_distinct(x, np.repeat(train, np.diff(at))) for x, at in _grams(*_sequences(data, text_at))]
    cuts = [np.searchsorted(C.bucket_of(x, n), np.arange(n + 1)).tolist() for x, _ in kinds]
    rows = []
    for b in range(n):
        if any(c[b] < c[b + 1] for c in cuts):
            own = [(x[c[b] : c[b + 1]], k[c[b] : c[b + 1]], bits) for (x, k), c, bits in zip(kinds, cuts, (64, CODE_BITS, CODE_BITS))]
            rows.append((chunk, b, C.pack_arrays(*[a for x, k, bits in own for a in (_put(x, b, n, bits), *_small(k))]), None))
    del kinds
    yield from _pieces(rows, _CHUNK)


def _told(got: list[list[np.ndarray]], bits_per_key: int) -> tuple[list[list[np.ndarray]], int, int]:
    """What one bucket answers each chunk that asks it, kind by kind, so that one kind's arrays are held at once: exact counts of words,
    levels of words, pairs and triples; and the bucket's tokens and words."""
    out: list[list[np.ndarray]] = [[] for _ in got]
    tokens = words = 0
    for kind in range(3):
        codes = [_get(x[3 * kind]) for x in got]
        where = np.cumsum([0, *map(len, codes)]).tolist()
        codes = np.concatenate(codes)
        counts = np.concatenate([_full(x[3 * kind + 1], x[3 * kind + 2]) for x in got])
        by = np.argsort(codes)
        counts, codes = counts[by], codes[by]
        first, many = C.runs_of(codes)
        counts, codes = np.add.reduceat(counts, first) if len(first) else counts, codes[first]
        del first
        if kind == 0:
            tokens, words = int(counts.sum()), int((counts > 0).sum())
            each = np.empty(where[-1], np.int64)
            each[by] = np.repeat(counts, many)
            for k, x in enumerate(out):
                x += _small(each[where[k] : where[k + 1]])
            del each
        there = counts > 0
        level = CountFilter(codes[there], counts[there], bits_per_key).levels(codes).astype(np.uint8)
        del codes, counts, there
        each = np.empty(where[-1], np.uint8)
        each[by] = np.repeat(level, many)
        for k, x in enumerate(out):
            x.append(each[where[k] : where[k + 1]])
    return out, tokens, words


def answers(chunks: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """A row for each chunk and each of n buckets that it asks: exact counts of its words and levels of its words, pairs and triples
    there, in order of their codes; tokens and words of a bucket stand in one row of it."""

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, (_, _, train, text_at, data) in zip(batch.column("chunk").to_pylist(), C.blobs(batch.column("data"))):
                yield from _asked(chunk, train, text_at, data, n)
                C.give_back()

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in C.by_key(batches, "bucket"):
            chunk = [c for b in held for c in b.column("chunk").to_pylist()]
            told, tokens, words = _told([x for b in held for x in C.blobs(b.column("data"))], bits_per_key)
            del held
            rows = [(c, int(bucket), C.pack_arrays(*told[k]), 0 if k else tokens, 0 if k else words) for k, c in enumerate(chunk)]
            del told
            yield from _pieces(rows, _ANSWER)
            del rows
            C.give_back()

    return C.materialise(C.exchange(chunks.mapInArrow(asked, _CHUNK_SQL), n, "bucket").mapInArrow(answered, _ANSWER_SQL), "lm-answers")


def _counted(held: list[pa.RecordBatch], marks: int) -> tuple:
    """A chunk and its answers: ids, which are null, train, and for each token its text's offsets, its exact count and the levels of
    c(w), c(v), c(v w), c(u v), c(u v w); the last two are 0 for a text's first token."""
    (ids, null, train, text_at, data), *got = [x for b in held for x in C.blobs(b.column("data"))]
    (one, at), (two, two_at), (three, three_at) = _grams(*_sequences(data, text_at))
    join = lambda i: np.concatenate([x[i] for x in got] or [np.zeros(0, np.uint8)])
    exact, c1 = _lookup(one, (marks, MARK), np.concatenate([_full(x[0], x[1]) for x in got] or [np.zeros(0, np.int64)]), join(2))
    c2, c3 = (_lookup(x, (0,), join(i))[0] for x, i in ((two, 3), (three, 4)))
    pos, _ = C.windows_of(at, 2)  # each token but the begin is the second of one pair
    u, context = np.zeros(len(two), np.uint8), np.zeros(len(two), np.uint8)
    later = np.ones(len(two), bool)
    later[two_at[:-1]] = False
    place = np.flatnonzero(later)
    u[place], context[place] = c3, c2[place - 1]
    return ids, null, train, two_at, exact[pos + 1], [c1[pos + 1], c1[pos], c2, context, u]


def _kinds(levels: list[np.ndarray], marks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the different tuples of levels each token has, and the counts of these."""
    key = np.zeros(len(levels[0]), U64)
    for i, x in enumerate(levels):
        key |= x.astype(U64) << U64(8 * i)
    key, which = np.unique(key, return_inverse=True)
    mean = CountFilter.mean(np.arange(LEVELS + 1))
    mean = np.concatenate([mean, np.full(MARK + 1 - len(mean), float(marks))])
    return which, [mean[(key >> U64(8 * i)).astype(np.uint8)] for i in range(len(levels))]


def probability(total: float, a: float, b: float, word, before, pair, context, triple) -> np.ndarray:
    """P3 of tokens with these counts."""
    p = np.minimum((word + 1) / total, 1.0)
    p = (np.minimum(pair, before) + a * p) / (before + a)
    return (np.minimum(triple, context) + b * p) / (context + b)


def _with_answers(chunks: DataFrame, told: DataFrame, n: int, per: int) -> DataFrame:
    """Chunks beside their answers.  A chunk's number holds its partition and its place there, below `per`; counted through, they are
    dealt in turn, as a hash would put many chunks of a few megabytes each in one task."""
    both = chunks.select("chunk", "bucket", "data").unionAll(told.select("chunk", "bucket", "data"))
    place = F.shiftright("chunk", 32) * F.lit(per) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))
    return both.repartitionById(n, F.pmod(place, F.lit(n)).cast("int")).sortWithinPartitions("chunk", "bucket")


def sizes_of(chunks: DataFrame) -> tuple[int, int]:
    """The number of training documents, and the most chunks of one partition."""
    per = F.coalesce(F.max(F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))), F.lit(0)) + 1
    return tuple(chunks.agg(F.coalesce(F.sum("docs"), F.lit(0)), per).first())


some_chunks = sizes_of  # its name in tests


def likeliest(scored: DataFrame, grid: list[tuple[float, float]]) -> int:
    """The place in grid of the pair that makes all training tokens likeliest, each left out of its own counts."""
    sums = scored.where("fit is not null").agg(*[F.coalesce(F.sum(F.col("fit")[i]), F.lit(0.0)) for i in range(len(grid))]).first()
    return min(range(len(grid)), key=lambda i: (-sums[i], i))


def fit_strengths(chunks: DataFrame, told: DataFrame, n: int, total: float, marks: int, per: int) -> tuple[float, float]:
    """The pair of GRID that makes the training tokens likeliest, each left out of its own counts."""
    return GRID[likeliest(scores(chunks, told, n, total, marks, per, GRID), GRID)]


def scores(chunks: DataFrame, told: DataFrame, n: int, total: float, marks: int, per: int, grid: list[tuple[float, float]]) -> DataFrame:
    """The chunks' documents: doc_id, train, n_tokens, n_known, base_score, and a score by each pair of grid, s0, s1, ... (log10
    probabilities of the text).  One row of a chunk has, as fit, the chunk's log10 likelihood by each pair."""
    kinds = [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64())]
    schema = pa.schema([*kinds, *[(f"s{i}", pa.float64()) for i in range(len(grid))], ("fit", pa.list_(pa.float64()))])
    sql = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, " + "".join(f"s{i} double, " for i in range(len(grid))) + "fit array<double>"

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in C.by_key(batches, "chunk"):
            ids, null, train, at, exact, levels = _counted(held, marks)
            size = np.diff(at)
            which, counts = _kinds(levels, marks)
            known, base = np.add.reduceat((exact > 0).astype(np.int64), at[:-1]), np.add.reduceat(np.log10(exact + 1.0), at[:-1]) - size * math.log10(total)
            often = np.bincount(which[np.repeat(train, size)], minlength=len(counts[0]))
            without = [np.maximum(x - 1, 0) for x in counts]
            each = [np.add.reduceat(np.log10(probability(total, a, b, *counts))[which], at[:-1]) for a, b in grid]
            fit = [float((often * np.log10(probability(total, a, b, *without))).sum()) for a, b in grid]
            cols = [pa.array(ids, mask=null), pa.array(train), pa.array(size), pa.array(known), pa.array(base), *map(pa.array, each)]
            del exact, levels, which, held
            yield pa.RecordBatch.from_arrays([*cols, pa.array([fit] + [None] * (len(ids) - 1), schema.field("fit").type)], schema=schema)
            C.give_back()

    return _with_answers(chunks, told, n, per).mapInArrow(scored, sql)


def score_documents(docs: DataFrame, train, bits_per_key: int = BITS_PER_KEY, strengths: tuple[float, float] | None = None) -> DataFrame:
    """docs (doc_id, text), train: a boolean column of them.  The contract's columns; strengths a and b are fitted if not given."""
    C.small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train"))
    n = C.buckets_for(keyed.select("text"))
    chunks = chunks_of(keyed)
    told = answers(chunks, n, bits_per_key)
    marks, per = sizes_of(chunks)
    tokens, distinct = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    tokens, total = tokens + marks, tokens + marks + distinct + (marks > 0) + 1
    grid = GRID if strengths is None else [strengths]
    out = scores(chunks, told, n, total, marks, per, grid)
    if len(grid) > 1:
        out = C.materialise(out, "lm-scores")
    best = likeliest(out, grid) if len(grid) > 1 else 0
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", F.col(f"s{best}").alias("score"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(C.documents(spark, sf_dir), C.crc_mod(F.col("doc_id"), 7) != 2)
